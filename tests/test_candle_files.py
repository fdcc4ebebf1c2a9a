"""CSV uploads: encodings, headers, quoted fields, epochs and the quarantine."""

import pytest

from candleframe.sources import candle_files as CF

FILES = {
    "plain.csv": "timestamp,open,high,low,close,volume\n100,1,2,0.5,1.5,10\n160,1,2,0.5,n/a,10\n220,1,2,0.5,1.5,\n280,1,2\n340,1,2,0.5,inf,9,9\n\n",
    "ms.csv": "﻿Datetime,Volume,CLOSE,Low,High,Open,Timestamp\r\nx,10,1.5,0.5,2,1,1700000000000\r\n,11,2.5,0.5,3,1,1700000060500\r\n",
    "quoted.csv": 'timestamp,open,high,low,close,volume,note\n100,"1","2",0.5,"1.5",10,"a, ""b"""\n,1,2,0.5,1.5,10,\n"100",1,2,0.5,1.5,10,"é"\n',
    "bare.csv": "100,1,2,0.5,1.5,10\n160,1,2,0.5,1.5,10\n",
    "empty.csv": "",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("uploads")
    for name, text in FILES.items():
        (base / name).write_bytes(text.encode("utf-8"))
    (base / "latin.csv").write_bytes("Timestamp,Open,High,Low,Close,Volume,Note\n100,1,2,0.5,1.5,10,café\n160,1,2,0.5,1.5,11,plain\n".encode("latin-1"))
    return str(base)


def rows(df):
    return sorted(((r.file.rsplit("/", 1)[1], r.timestamp, r.open, r.close, r.volume, r.encoding) for r in df.collect()), key=str)


def test_upload_path(spark, folder):
    records = CF.read_uploads(spark, folder).cache()
    assert rows(CF.kept(records)) == sorted([
        ("plain.csv", 100.0, 1.0, 1.5, 10.0, "UTF-8"), ("plain.csv", 160.0, 1.0, None, 10.0, "UTF-8"), ("plain.csv", 220.0, 1.0, 1.5, None, "UTF-8"),
        ("ms.csv", 1700000000.0, 1.0, 1.5, 10.0, "UTF-8"), ("ms.csv", 1700000060.5, 1.0, 2.5, 11.0, "UTF-8"),
        ("quoted.csv", 100.0, 1.0, 1.5, 10.0, "UTF-8"), ("quoted.csv", None, 1.0, 1.5, 10.0, "UTF-8"), ("quoted.csv", 100.0, 1.0, 1.5, 10.0, "UTF-8"),
        ("latin.csv", 100.0, 1.0, 1.5, 10.0, "ISO-8859-1"), ("latin.csv", 160.0, 1.0, 1.5, 11.0, "ISO-8859-1"),
    ], key=str)
    bad = sorted((r.file.rsplit("/", 1)[1], r.line, r.reason) for r in CF.quarantine(records).collect())
    assert bad == [
        ("bare.csv", "100,1,2,0.5,1.5,10", "no header"), ("bare.csv", "160,1,2,0.5,1.5,10", "no header"),
        ("plain.csv", "280,1,2", "field count"), ("plain.csv", "340,1,2,0.5,inf,9,9", "field count"),
    ]


def test_strict_path(spark, folder):
    records = CF.read_uploads(spark, folder, strict=True)
    reasons = sorted((r.file.rsplit("/", 1)[1], r.reason) for r in CF.quarantine(records).collect())
    assert [r for r in reasons if r[1].startswith("not")] == [("plain.csv", "not a number: close"), ("plain.csv", "not a number: volume"), ("quoted.csv", "not a number: timestamp")]
    whole = CF.read_uploads(spark, folder).count()
    assert CF.kept(records).count() + CF.quarantine(records).count() == whole == 14


def test_text_is_decoded(spark, folder):
    lines = {r.line for r in CF.candle_lines(spark, folder).collect()}
    assert "100,1,2,0.5,1.5,10,café" in lines and '"100",1,2,0.5,1.5,10,"é"' in lines
    assert "Datetime,Volume,CLOSE,Low,High,Open,Timestamp" in lines
