import pyarrow as pa

from seqloom.operators.splits import _letters


def test_letters_of_a_task():
    """Every letter once, those of several bytes and null rows included."""
    rows = ["acgt", None, "", "n\u00e9x", "\u4e2dA\U0001f600"]
    (out,) = _letters([pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["sequence"])])
    assert out.column(0).to_pylist() == sorted(set("".join(r or "" for r in rows)))
