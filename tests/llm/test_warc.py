import hashlib
import io
import struct

import pytest
import zstandard as zstd

from doeffect.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, first long"


def pages():
    big = "<html>" + "café " * 50 + "</html>"
    rows = [(i, f"http://a/{i}", f"<html>{i} " + "text " * (i % 40) + "</html>") for i in range(60)]
    rows += [(100, "http://b/", big), (99, None, big), (101, "http://c/\r\nX: y", big), (102, "u", None), (103, "u", ""), (104, "u", "short"), (105, "u", "short")]
    rows += [(None, "n", big), (None, "n", "z" * 200), (106, "v", "\r\n\r\n" * 100), (107, "v", "y" * 300000), (99, None, big)]
    return [(*r, "d", 1) for r in rows]


def brute(rows):
    out = []
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "").encode() == raw and r[0] is not None]
        first = min(ids, default=None)
        revisit = len(raw) >= 100 and page_id != first
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def bag(rows):
    return sorted(map(tuple, rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_round_trip(spark):
    rows = pages()
    got = W.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert bag(r[:5] for r in got) == bag(brute(rows))
    assert {r.url for r in got if r.page_id == 101} == {"http://c/%0D%0AX: y"}


def test_archive_layout(spark, tmp_path):
    files = W.write(spark.createDataFrame(pages(), SCHEMA).coalesce(1), f"file://{tmp_path}").collect()
    assert sum(f.records for f in files) == len(pages()) and sum(f.bytes for f in files) == sum(p.stat().st_size for p in tmp_path.iterdir())
    for p in tmp_path.iterdir():
        raw = p.read_bytes()
        magic, n = struct.unpack("<II", raw[:8])
        assert magic == W.DICTIONARY_MAGIC and not p.name.endswith(".part")
        # Each record can be read alone, with the dictionary of the first frame.
        one = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw[8 : 8 + n])).decompressobj().decompress(raw[8 + n :])
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
        assert b"WARC-Type: warcinfo" in one and p.name.encode() in one


def fields_of(folder):
    out = []
    for p in folder.iterdir():
        with open(p, "rb") as stream:
            for raw in W.frames(stream):
                head = raw.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]
                out.append(dict(line.split(": ", 1) for line in head))
    return out


def test_revisits_can_be_followed(spark, tmp_path):
    """Each revisit names the record id, url and date of its response."""
    rows = pages()[:-1] + [(*pages()[5][:2], "<p>" + "w" * 150, "d", 1), (300, "http://z/", "<p>" + "w" * 150, "d", 1)]
    W.write(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}").count()
    fields = fields_of(tmp_path)
    ids = [f["WARC-Record-ID"] for f in fields]
    assert len(set(ids)) == len(ids)
    by_id = {f["WARC-Record-ID"]: f for f in fields}
    revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert len(revisits) >= 3
    for f in revisits:
        response = by_id[f["WARC-Refers-To"]]
        assert response["WARC-Type"] == "response" and response["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
        assert response["X-Page-ID"] == f["X-Refers-To-Page-ID"] and response["WARC-Date"] == f["WARC-Refers-To-Date"]
        assert response.get("WARC-Target-URI") == f.get("WARC-Refers-To-Target-URI")


def test_repeated_responses_have_ids_of_their_own(spark, tmp_path):
    W.write(spark.createDataFrame(pages(), SCHEMA), f"file://{tmp_path}").count()
    fields = fields_of(tmp_path)
    ids = [f["WARC-Record-ID"] for f in fields]
    assert len(set(ids)) == len(ids)
    # Page 99 is there twice: its revisits name the page, but no record of the two.
    of_99 = [f for f in fields if f.get("X-Refers-To-Page-ID") == "99"]
    assert of_99 and all("WARC-Refers-To" not in f and "WARC-Refers-To-Date" in f for f in of_99)


def test_dictionary_takes_pieces_from_anywhere(spark):
    """What payloads share far behind their beginning is in the dictionary."""
    import random

    r = random.Random(1)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    shared = noise(1500)
    rows = [(i, "u", noise(20000) + shared + noise(300), "d", 1) for i in range(60)]
    raw = W.train(spark.createDataFrame(rows, SCHEMA))
    assert 0 < len(raw) <= W.DICTIONARY_BYTES and any(shared[k : k + 60].encode() in raw for k in range(0, 1400, 20))
    assert W.train(spark.createDataFrame(rows[:0], SCHEMA)) == b""


def test_damage_is_noticed():
    raw = W.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), False, "<urn:uuid:1>")
    assert W.parse(raw)["payload_bytes"] == 7
    with pytest.raises(ValueError):
        W.parse(raw.replace(b"payload", b"PAYLOAD"))
    cut = zstd.ZstdCompressor().compress(raw)[:-3]
    with pytest.raises(ValueError):
        list(W.frames(io.BytesIO(b"\0" * 0 + struct.pack("<II", W.DICTIONARY_MAGIC, 0) + cut)))


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, "u", "x", "d", 1)], SCHEMA)
    assert [tuple(r)[:4] for r in W.round_trip(one).collect()] == [(1, 1, hashlib.sha256(b"x").hexdigest(), "response")]
