"""Sharding, site lines and license scan, on odd input and against plain Python."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm.licenses import TEMPLATES, scan_licenses
from ledgerlight.llm.lines import boilerplate_lines, drop_site_lines, host_of, html_lines
from ledgerlight.llm.sharding import shuffled_places, write_shards

SCHEMA = "doc_id long, text string, source string, start long, w string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_shards_hold_every_record_once(spark):
    rows = [(i, f"text {i % 37} é", "a") for i in range(501)] + [(7, "same", "a")] * 300 + [(None, None, None), (3, "", "b")]
    got = shuffled_places(_docs(spark, rows), 8, min_buckets=16).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    rising = sum(a < b for a, b in zip(order, order[1:]))
    assert 0.3 * len(order) < rising < 0.7 * len(order)


def test_fewer_records_than_shards_and_none(spark):
    assert shuffled_places(_docs(spark, []), 8).count() == 0
    got = shuffled_places(_docs(spark, [(1, "a", "s"), (2, "b", "s"), (3, None, "s")]), 8).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0), (2, 0)]


def test_shards_are_written_with_texts(spark, tmp_path):
    docs = _docs(spark, [(i, None if i == 5 else f"text {i}", "a") for i in range(50)] + [(1, "text 1", "a")])
    write_shards(docs, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert {r.shard: r.n for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {0: 13, 1: 13, 2: 13, 3: 12}


@pytest.mark.parametrize("settled", [False, True])
def test_shards_keep_each_record_whole(spark, tmp_path, settled):
    # Texts of equal size and CRC32, and null beside '', all under one key.
    one, other = "plumless", "buckeroo"
    assert zlib.crc32(one.encode()) == zlib.crc32(other.encode())
    docs = _docs(spark, [(None, t, "s") for t in (one, other, None, "") * 25] + [(i, f"text {i}", "s") for i in range(300)])
    if settled:
        docs.write.parquet(str(tmp_path / "in"))
        docs = spark.read.parquet(str(tmp_path / "in"))
    write_shards(docs, str(tmp_path / "out"), 3, min_buckets=16)
    got = spark.read.parquet(str(tmp_path / "out")).select("*", F.input_file_name().alias("file")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    files = {}
    for r in got:
        files.setdefault((r.shard, r.file), []).append(r.slot)
    assert all(slots == list(range(slots[0], slots[0] + len(slots))) for slots in files.values())
    for shard in range(3):
        slots = sorted(r.slot for r in got if r.shard == shard and r.doc_id is None)
        assert 10 < len(slots) < 60 and sorted(r.slot for r in got if r.shard == shard) == list(range(133 + (shard == 0)))


def _plain_cut(rows, ratio, least):
    pages = {}
    for _, text, site in rows:
        pages.setdefault(site or "", set()).add(text)
    bad = {}
    for site, texts in pages.items():
        seen = Counter(line for t in texts for line in {x.strip(" ") for x in (t or "").split("\n")} if line)
        bad[site] = {line for line, n in seen.items() if n >= least and n / len(texts) > ratio}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad[s or ""]), s) for i, t, s in rows]


def test_site_lines(spark):
    rows = [(i, f"menu \nbody {i}\n\nfoot {i % 3}", "hot") for i in range(60)]
    rows += [(100 + i, f"menu\nonce {i}", f"s{i}") for i in range(5)]
    rows += [(200 + i, "copy one\ncopy two", "copies") for i in range(20)] + [(300, "copy one\nother", "copies")]
    rows += [(400, None, "hot"), (401, "", "hot"), (402, "menu", None), (1, "menu \nbody 1\n\nfoot 1", "hot"), (None, "menu", "hot")]
    rows += [(500, "\n".join(f"line {i}" for i in range(20_000)) + "\nmenu", "hot")]
    got = drop_site_lines(_docs(spark, rows), "source", "text")
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "dropped_lines"]
    key = lambda r: (str(r[0]), str(r[2]), str(r[1]))
    assert sorted([(r.doc_id, r.text, r.source) for r in got.collect()], key=key) == sorted(_plain_cut(rows, 0.1, 2), key=key)
    five = drop_site_lines(_docs(spark, rows), "source", "text", min_pages=5)
    assert sorted([(r.doc_id, r.text, r.source) for r in five.collect()], key=key) == sorted(_plain_cut(rows, 0.1, 5), key=key)
    assert {r.site for r in boilerplate_lines(_docs(spark, rows), "source", "text").collect()} == {"hot", "copies"}
    assert drop_site_lines(_docs(spark, []), "source", "text").count() == 0


def test_html_lines_and_hosts(spark):
    page = "<html><head><title>T</title><script>var a='<p>';</script></head><body><p>One <b>two</b></p><!-- x --><p>three<br>four</p></body>"
    row = spark.createDataFrame([(page, "HTTP://A.Example.com:80/x"), (None, None)], "h string, u string").select(
        html_lines(F.col("h")), host_of(F.col("u"))).collect()
    assert row[0][0].strip().split("\n") == ["T", "One two", "three", "four"] and row[0][1] == "a.example.com"
    assert row[1][0] is None and row[1][1] == ""


PLAIN = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def _plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in PLAIN.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


@pytest.fixture(scope="module")
def license_rows():
    texts = [
        "Released under the MIT License.", "x Under-the,MIT\nlicense; under the mit license CC BY-NC 4.0", "cc by nc cc by nc by nc",
        "Licensed under the Apache License, Version 2.0.", "apache license version 20", "under the mit licenses mit license é",
        "This work is licensed under the GNU General Public License, version 3.", "mit der license", "", None, "über ÜBER Kelvin K",
        "Subject to the terms of the Mozilla Public License, v. 2.0.", "permission mit license apache", "pad " * 30_000 + "under the MIT license",
        "license " * 5000 + "mit apache version 2 cc by nc",
    ]
    return [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[1], None)]


def test_license_scan(spark, license_rows):
    got = scan_licenses(_docs(spark, license_rows)).collect()
    view = lambda r: (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
    assert sorted(map(view, got), key=str) == sorted([(i, *_plain_scan(t)) for i, t, _ in license_rows], key=str)
    labels = {r.doc_id: r.labels for r in got if r.doc_id is not None}
    assert labels[0] == "mit" and labels[1] == "cc-by-nc,mit" and labels[3] == "apache-2" and labels[6] == "gpl-3"
    assert labels[11] == "mpl-2" and labels[13] == "mit" and labels[8] == labels[9] == labels[7] == ""
    assert all(0 <= r.score <= 1 for r in got)
    assert scan_licenses(_docs(spark, [])).count() == 0


def test_license_scan_of_all_templates_in_one_file(spark):
    lines = [line for _, line, _ in TEMPLATES]
    three = [line for label, line, _ in TEMPLATES if label in ("bsd", "isc", "gpl-3")]
    texts = [*lines, "\n".join(lines), "\n".join(three), "of the " * 500 + lines[4]]
    got = {r.doc_id: r for r in scan_licenses(_docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i].labels for i in range(len(lines))] == [label for label, _, _ in TEMPLATES]
    assert got[len(lines)].labels == ",".join(sorted({label for label, _, _ in TEMPLATES}))
    assert got[len(lines) + 1].labels == "bsd,gpl-3,isc" and got[len(lines) + 2].labels == "gpl-3"
    assert all(r.score > 1 - 1e-9 for r in got.values())


def test_license_score_is_the_largest_share_of_every_file(spark):
    texts = ["licensed under the gnu general public", "permission is hereby granted free of", "the software is licensed under the terms of the mozilla public domain",
             "free and unencumbered software released into the public", "of the x of the", "nothing here", "", None, TEMPLATES[4][1], "under the mit license and this is free"]
    words = [(t or "").split() for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1e-9
    def share(ws, line):
        at = lambda off: sum(idf(w) for j, w in enumerate(line) if 0 <= off + j < len(ws) and ws[off + j] == w)
        return max((at(off) for off in range(-len(line), len(ws))), default=0) / sum(map(idf, line))
    got = {r.doc_id: r.score for r in scan_licenses(_docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, ws in enumerate(words):
        assert got[i] == pytest.approx(max(share(ws, line.split()) for _, line, _ in TEMPLATES)), texts[i]


def test_small_sites_lose_their_menu_and_copies_count_on_request(spark):
    from ledgerlight.llm.lines import drop_site_lines

    rows = [(i, f"s{n}", f"menu\nonly {n} {i}") for n in (2, 4, 5, 30) for i in range(n)] + [(9, "one", "menu\nx")]
    pages = spark.createDataFrame(rows, "id long, site string, text string")
    got = drop_site_lines(pages, "site", "text").collect()
    assert all(r.dropped_lines == (r.site != "one") and ("menu" in r.text) == (r.site == "one") for r in got)
    # 3 of 12 pages are copies of one
    rows = [(i, "s", f"a {i}\nb") for i in range(9)] + [(9 + i, "s", "copied\nb") for i in range(3)]
    pages = spark.createDataFrame(rows, "id long, site string, text string")
    assert sum(r.dropped_lines for r in drop_site_lines(pages, "site", "text", max_ratio=0.2).collect()) == 12
    assert sum(r.dropped_lines for r in drop_site_lines(pages, "site", "text", max_ratio=0.2, copies=True).collect()) == 15


def test_shards_of_a_partitioned_table_with_all_columns(spark, tmp_path):
    # every folder holds a file of the same name: one row of each stands at the same place
    rows = spark.range(4000).select("id", (F.col("id") % 200).alias("day"), F.concat(F.lit("t"), "id").alias("text"), F.col("id").alias("slot"), F.lit(None).cast("string").alias("shard"))
    rows.coalesce(1).write.partitionBy("day").parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    write_shards(docs, str(tmp_path / "out"), 4, min_buckets=64)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.id, r.day, r.text, r.slot) for r in got) == [(i, i % 200, f"t{i}", i) for i in range(4000)]
    assert {s: n for s, n in Counter(r.shard_ for r in got).items()} == {0: 1000, 1: 1000, 2: 1000, 3: 1000}
    from ledgerlight.llm.sharding import _placed

    sizes = [r["count"] for r in _placed(docs).groupBy(F.pmod(F.xxhash64(F.lit(17), "file", "row"), F.lit(64))).count().collect()]
    assert len(sizes) == 64 and max(sizes) <= 2 * 4000 / 64
