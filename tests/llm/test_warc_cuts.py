"""Archives that end too soon."""

import gzip
import io
import zlib

import pytest

from shapeloom.llm import warc_members as W


def records(n=3):
    return [W.record(str(k), f"http://x/{k}", b"payload %d " % k * 50, "0" * 64, None) for k in range(n)]


def read(data):
    return list(W.records(W.inflated(io.BytesIO(data))))


@pytest.mark.parametrize("members", [False, True])
def test_every_cut_is_an_error_or_whole_members(members, tmp_path):
    recs = records()
    parts = [gzip.compress(r) for r in recs] if members else [gzip.compress(b"".join(recs))]
    data, ends, size = b"".join(parts), {}, 0
    for k, p in enumerate(parts):
        size += len(p)
        ends[size] = recs[: k + 1] if members else recs
    ends[0] = []
    for cut in range(len(data) + 1):
        if cut in ends:
            assert read(data[:cut]) == ends[cut]
        else:
            with pytest.raises((ValueError, zlib.error)):
                read(data[:cut])
    (tmp_path / "a.warc.gz").write_bytes(data[:-1])
    with pytest.raises(ValueError, match="ends within"):
        W.normalise(str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc.gz"))


def test_cut_at_a_flush_between_records():
    recs, z = records(), zlib.compressobj(6, zlib.DEFLATED, 31)
    first = z.compress(recs[0]) + z.flush(zlib.Z_FULL_FLUSH)
    assert read(first + z.compress(recs[1]) + z.flush()) == recs[:2]
    with pytest.raises(ValueError, match="gzip member"):
        read(first)


def test_output_beyond_a_piece(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 64)
    recs = [W.record("1", None, b"a" * 100_000, "0" * 64, None), *records(2)]
    assert read(gzip.compress(b"".join(recs))) == recs
