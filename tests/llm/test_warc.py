import base64
import hashlib

import pytest
import zstandard

from daymill.llm import warc
from daymill.session import work_folder


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark, monkeypatch):
    big = "<p>" + "öé x" * 50_000
    rows = [(3, "http://a/ b\r\n", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "u", None), (9, "u", ""), (4, "u", big), (4, "u", big), (None, "u", "<p>one</p>"), (None, "v", "alone")]
    pages = spark.createDataFrame([(*r, "x", b"y") for r in rows], "page_id long, url string, html string, payload string, digest binary").repartition(3)
    archives = warc.write_archives(pages, work_folder(spark, "warc"))
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(archives).collect()
    assert sorted((r.page or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == [
        (0, "response", 0, 5), (0, "revisit", 1, 10), (1, "response", 0, 10), (2, "response", 0, 0), (3, "revisit", 1, 10),
        (4, "response", 0, len(big.encode())), (4, "response", 0, len(big.encode())), (9, "revisit", 2, 0)]
    for r in got:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
    assert {r.payload_digest for r in got} == {sha(t) for t in ("<p>one</p>", "", big, "alone")}
    assert "http://a/%20b%0D%0A" in {r.url for r in got}


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, work_folder(spark, "warc"), least=3)).collect()
    assert sorted((r.page, r.refers_to) for r in got if r.refers_to) == [(4, 3)]


@pytest.mark.parametrize("count", [1, 5, 400])
def test_records_are_frames_of_their_own(count):
    records = [warc.record(i, "http://x/" + str(i), f"<html>{i} words and words {i * i}</html>".encode() * 5, b"0" * 20, None, "2000-01-01T00:00:00Z") for i in range(count)]
    data = warc.archive(records)
    assert data[:4] == warc.DICTIONARY_FRAME
    end = 8 + int.from_bytes(data[4:8], "little")
    own, rest, plain = zstandard.ZstdCompressionDict(data[8:end]), data[end:], []
    while rest:
        d = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
        plain.append(d.decompress(rest))
        rest = d.unused_data
    assert plain == records
    assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.open_archive(data)] == [r.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2][:-4] for r in records]


def test_damage_is_noticed_and_empty_is_empty(spark):
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").digest(), None, "d")
    folder = work_folder(spark, "warc")
    store, at = warc._store(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/x.warc.zst") as f:
        f.write(warc.archive([good]))
    bad = spark.createDataFrame([(f"{folder}/x.warc.zst", 1, 1)], warc.MANIFEST)
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archives(bad).collect()
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, folder)).count() == 0
