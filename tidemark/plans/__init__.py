"""Plans of the library."""
from tidemark.plans import registry as registry  # first, so that the modules of queries find each other in any order
