import hashlib
import random
import re
import time

from tidemark.llm import pii
from tidemark.llm.common import load

KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def brute_base(text):
    out = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(KINDS[k], m[0])]
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in KINDS]


def run(spark, rows, tmp_path, docs_of):
    docs_of(rows, "1 as th").write.parquet(f"{tmp_path}/documents.parquet")
    return pii.query(spark, str(tmp_path)).collect()


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in load(spark, sf_dir, "documents").collect()}
    rows = pii.query(spark, sf_dir).collect()
    check(rows, texts)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0


def test_random_texts(spark, docs_of, tmp_path):
    rnd = random.Random(5)
    bits = ["a.b@c.de", "@", "x+", "%", ".com", "..", "1.2.3.4", "256.1.1.1", ".7", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "(", ")", " ", "-", "é😀", "\n", "12345", "0", "word", "a@b", "+49.30.1234567"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))) for i in range(1500)]
    rows += [(9000, None), (9001, ""), (9002, "a" * 200_000 + "@x.y" + ".z" * 20_000), (9003, "1" * 100_000), (9004, "1.2.3.4.5.6.7.8.9.10.11.12 a@b.c+d@e.f")]
    check(run(spark, rows, tmp_path, docs_of), dict(rows))


def test_terms_that_disclose(spark, docs_of, tmp_path):
    rows = [(i, f"Filler words number {i} come here, then Zanzibart writes from zed@corp.example and closes the common letter") for i in range(4)]
    rows += [(i, f"the common letter of other people without any address, closes and writes {i}, here come words then filler from number") for i in range(10, 60)]
    rows += [(70, None), (71, ""), (None, "nobody")]
    got = {r.doc_id: r for r in run(spark, rows, tmp_path, docs_of)}
    assert len(got) == len(rows)
    text = dict(rows)
    terms = lambda d: [text[d][int(s) : int(e)] for k, s, e in (x.split(":") for x in got[d].spans.split(",") if x) if k == "term"]
    assert all(terms(i) == ["Zanzibart"] for i in range(4)) and not any(got[i].n_term for i in range(10, 60))
    clean = {r.doc_id: r for r in pii.sanitised(docs_of(rows, "2 as th")).collect()}
    assert clean[0].text == "Filler words number 0 come here, then  writes from [EMAIL] and closes the common letter"
    assert clean[70].text is None and clean[None].text == "nobody" and clean[11].text == text[11] and clean[0].th == 2


def test_repeated_rows_change_nothing(spark, docs_of):
    rows = [(i, f"Filler {i} and Zanzibart writes from zed@corp.example today") for i in range(4)] + [(i, f"other people and words today {i}") for i in range(10, 60)]
    terms = lambda x: {r.doc_id: [tuple(t)[:3] for t in r.terms] for r in pii.spans(docs_of(x)).collect()}
    want = terms(rows)
    assert all(len(want[i]) == 4 for i in range(4))  # Filler, Zanzibart, writes, from
    assert terms(rows + [rows[0]] * 5 + [(700, rows[1][1])]) == {**want, 700: want[1]}


def test_terms_far_from_the_entity_are_found(spark, docs_of):
    rows = [(i, f"Dear Quibblemont,\n{'plain words of a letter ' * 40} answer to zed@corp.example {i}") for i in range(4)] + [(i, f"plain words of a letter answer dear from to {i}") for i in range(10, 90)]
    got = {r.doc_id: r.text for r in pii.sanitised(docs_of(rows)).collect()}
    assert all("Quibblemont" not in got[i] and "plain words of a letter" in got[i] for i in range(4))


def test_many_matches_in_one_text_take_linear_time(spark, docs_of):
    def seconds(n):
        text = " ".join(f"user{i}@mail.example and some words" for i in range(n))
        t = time.perf_counter()
        row = pii.sanitised(docs_of([(1, text)])).first()
        assert row.text == " ".join(["[EMAIL] and some words"] * n)
        return time.perf_counter() - t

    seconds(50)
    few, many = seconds(2000), seconds(16_000)
    assert many < 16 * few, (few, many)


def test_clashing_columns(spark, docs_of):
    rows = [(1, "a@b.cd and 1.2.3.4"), (None, None), (3, "")]
    df = docs_of(rows).selectExpr("doc_id", "text", "doc_id AS th", "7 AS terms", "8 AS base", "9 AS words", "10 AS part", "11 AS parts", "12 AS copies", "13 AS __id")
    got = pii.sanitised(df).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == [(1, "[EMAIL] and [IP]"), (3, ""), (None, None)]
    assert all((r.terms, r.base, r.words, r.part, r.parts, r.copies, r["__id"]) == (7, 8, 9, 10, 11, 12, 13) for r in got)
    assert len(pii.spans(df).collect()) == 3


def test_empty(spark, docs_of):
    df = docs_of([])
    assert pii.spans(df).collect() == [] and pii.sanitised(df).collect() == []
