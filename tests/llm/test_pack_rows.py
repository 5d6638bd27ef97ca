"""Rows that open windows hold: one copy for a slice of few bytes, a copy of each row otherwise."""

import pyarrow as pa

from notespark.llm import pack_windows as pw
from notespark.llm import tokens


def test_few_bytes_are_copied_once():
    whole = pa.array([{"doc_id": k} for k in range(100_000)])
    rows, shared = pw._rows(whole.slice(500, 1000))
    assert shared and rows.offset == 0 and rows.to_pylist() == whole.slice(500, 1000).to_pylist()
    assert sum(b.size for b in rows.buffers() if b) < 2 * pw.SHARED_BYTES
    large, shared = pw._rows(pa.array([{"text": "x" * 1000}] * 100))
    assert not shared and len(large) == 100


def test_white_space_is_that_of_strings():
    assert all((c in tokens._SPACE) == c.isspace() for c in map(chr, range(0x3001)))
