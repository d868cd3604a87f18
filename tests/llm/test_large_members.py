"""Archive members much larger than a read."""

import gzip
import random

import pyarrow as pa

from ripplemark.llm import warc


def test_members_larger_than_a_read(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    bodies = [random.Random(n).randbytes(n) for n in (0, 10, 200_000, 999, 1001)]
    head = lambda n: f"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: {n}\r\n\r\n".encode()
    members = [gzip.compress(head(len(b)) + b + b"\r\n\r\n") for b in bodies]
    data = b"".join(members)
    for cuts in ([0], [0, 30, 50_000, len(data) - 5]):
        found = [r for start, end in zip(cuts, [*cuts[1:], len(data)]) for r in warc.records(pa.BufferReader(data), start, end, len(data))]
        assert [r.payload for r in found] == bodies
        assert [r.length for r in found] == [len(m) for m in members]
