"""Every registered query beside its SQL on the smallest tables."""

import sys

import pytest

sys.path.insert(0, "tools")

import check  # noqa: E402

from seqloom.queries import ENTRIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", sorted({e.build.__module__.rsplit(".", 1)[1] for e in ENTRIES.values()}))
def test_same_rows(spark, module):
    names = [n for n, e in ENTRIES.items() if e.build.__module__.endswith("." + module)]
    assert check.main(SF, names) == []


def test_every_query_has_sql():
    assert [n for n, e in ENTRIES.items() if not e.oracle] == []
