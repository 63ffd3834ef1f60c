"""The per-document part: decoding, tokenizing, tree construction, serialization. Plain Python, no Spark."""

import sys

#: Documents nest deeper than Python's default allows; walkers that call themselves need no C stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
