"""Print the formatted physical plan of registered queries.

    python -m tessera.plans.explain [sf_dir] key [key ...]
"""

from __future__ import annotations

import sys

from ..session import build_session
from . import QUERIES


def main(argv: list[str]) -> None:
    sf = "/root/testdata/sf0.01"
    if argv and "/" in argv[0]:
        sf, argv = argv[0], argv[1:]
    spark = build_session()
    for key in argv or sorted(QUERIES):
        print(f"==== {key}")
        QUERIES[key](spark, sf).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
