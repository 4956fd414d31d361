"""Operators on vectors, pages and conversations, and the pipeline."""

import hashlib
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from clearwell.llm import blocks, chat_format, components, permutation_index, warc_archive


def test_search_finds_most_and_ranks_exactly(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(3000, 24)).astype("float32")
    points[5:900] = points[4]  # a very common vector: ties go to the smaller id
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0, None] + [0.0] * 22), (5004, [1.0]), (None, [1.0] * 24), (7, rows[7][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = permutation_index.search(vectors, vectors.where("vec_id % 20 = 0"), 10, share=0.3).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(found) == list(range(0, 3000, 20))
    x, hits = points.astype("float64"), 0
    for q, own in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({i for i, _ in own} & set(np.lexsort((np.arange(len(s)), -s))[:10].tolist()))
        assert len(own) == 10 and all(v == pytest.approx(s[i], rel=1e-12) for i, v in own)
        assert [(-v, i) for i, v in own] == sorted((-v, i) for i, v in own)
    assert hits / (10 * len(found)) >= 0.9


def test_search_at_production_share_with_a_third_alike(spark):
    """A full block whose third is one vector: queries inside and outside the group, against brute force."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(permutation_index.BLOCK_VECTORS, 24))
    group = rng.permutation(len(x))[: len(x) // 3]
    x[group] = x[group[0]]
    asked = [*group[:40].tolist(), *np.setdiff1d(np.arange(len(x)), group)[:40].tolist()]
    vectors = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in sorted(permutation_index.search(vectors, vectors.where(F.col("vec_id").isin(asked)), 20).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(found) == sorted(asked) and all(len(f) == 20 for f in found.values())
    hits = {}
    for q, own in found.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hits[q] = len(set(own) & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist())) / 20
        first = [j for j in sorted(group.tolist()) if j != q]
        inside = [j for j in own if j in set(first)]
        assert inside == first[: len(inside)]
    assert min(hits[q] for q in asked[:40]) >= 0.95 and np.mean([hits[q] for q in asked[40:]]) >= 0.95


def test_search_of_few_and_none(spark):
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = permutation_index.search(few, few.where("vec_id % 20 = 0"), 20).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    assert permutation_index.search(few.limit(0), few.limit(0)).count() == 0


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{'é' * (i % 7)}{i % 30}</p>" * 40) for i in range(200)]
    rows += [(300, None, None), (301, "http://a\r\nb", ""), (302, "u", "\U0001f600" * 300_000), (None, "n", "alone"), (303, "u", "twice"), (303, "u", "twice")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).repartition(5)
    manifest = warc_archive.write_archives(pages, str(tmp_path / "warc"))
    got = warc_archive.read_archives(manifest).collect()
    assert len(got) == len(rows) == sum(r.records for r in manifest.collect())
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        keeper = last[html]
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), warc_archive.base32_sha1(html.encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id in (keeper, None) else ("revisit", keeper))
        assert r.record_type == "revisit" or bytes(r.payload) == html.encode()
    empty = warc_archive.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0 and warc_archive.read_archives(empty).count() == 0


def test_damaged_archives_are_refused(tmp_path):
    import io

    record = warc_archive.build_record(1, "u", b"payload", None, True)
    frame = zstandard.ZstdCompressor().compress(record)
    good = warc_archive.leading_frame(b"") + frame
    assert list(warc_archive.read_records(io.BytesIO(good))) == [record]
    headers, _, payload = warc_archive.parse_record(record)
    assert payload == b"payload" and headers["WARC-Type"] == "response"
    for bad in (frame, good[:-3], struct.pack("<II", warc_archive.SKIPPABLE, 99) + b"x"):
        with pytest.raises(warc_archive.ArchiveError):
            list(warc_archive.read_records(io.BytesIO(bad)))
    for bad in (record.replace(b"WARC/1.1", b"WARC/0.9"), record[:-1], record.replace(b"payload\r\n\r\n", b"Payload\r\n\r\n"), record.replace(b"WARC-Date", b"X-Date"),
                record.replace(b"WARC-Type: response", b"WARC-Type: metadata")):
        with pytest.raises(warc_archive.ArchiveError):
            warc_archive.parse_record(bad)


def test_layouts_by_fingerprint(spark):
    records = [
        '{"messages":[{"role":"user","content":"a"},{"content":null,"role":"assistant"}]}', '{"prompt":"p","completion":"c"}',
        '{"output":"o","instruction":"i"}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}',
        '{"input":{"question":"q"},"output":{"answer":"r"}}', '{"question":"q","answer":3}', '{"unknown":1}', "no json", "[1]", None, '{"messages":[]}']
    df = spark.createDataFrame(list(enumerate(records)), "id int, record string").withColumn("role", F.lit("clash"))
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat_format.canonical_turns(df).collect()}
    assert got[0] == ("messages", [("user", "a"), ("assistant", "")]) and got[1] == ("prompt", [("user", "p"), ("assistant", "c")])
    assert got[2] == ("instruction", [("user", "i"), ("assistant", "o")]) and got[3] == ("dialogue", [("user", "h"), ("assistant", "g")])
    assert got[4] == ("nested", [("user", "q"), ("assistant", "r")]) and got[5] == ("question", [("user", "q"), ("assistant", "3")])
    assert all(got[i] == (None, None) for i in range(6, 11))


def test_chat_round_trip(spark):
    nasty = ["", "\\", "\\\\l", "<|end|>\n", "<<|x|>", "a\\<|b", "</s>[INST] ok [/INST]", "\\l\\\\", "<|turn|>user<|body|>", "é\U0001f600\n", "\\e\\i", None]
    rows = [(c, t, role, nasty[(c * 5 + t) % len(nasty)]) for c in range(24) for t, role in enumerate(["system", "user", "assistant", None, "assistant"][: c % 6])]
    rows += [(99, 0, "user", "x"), (99, 0, "user", "x"), (None, None, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    got = chat_format.digest(chat_format.format_turns(chat_format.canonical_turns(chat_format.conversation_records(df)))).collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(want)
    for r in got:
        turns = sorted(want[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert chat_format.digest(chat_format.format_turns(chat_format.canonical_turns(chat_format.conversation_records(df.limit(0))))).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


def test_components_need_a_round_only_where_edges_are_no_stars(spark, monkeypatch):
    """Stars are known as such; what needs rounds ends without one more that changes nothing."""
    rounds = []
    monkeypatch.setattr(components, "stored", lambda df, purpose: rounds.append(purpose) or blocks.stored(df, purpose))
    stars = [(9, 1), (1, 8), (9, 1), (1, 9), (20, 30), (31, 20)]
    for edges, most in ((stars, 1), ([*stars, (30, 9)], 3), ([], 1)):
        rounds.clear()
        got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {n: 1 if n < 10 or len(edges) > 6 else 20 for e in edges for n in e}
        assert len(rounds) <= most


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(5)
    for n, m in ((400, 260), (400, 420), (60, 400)):
        edges = rng.integers(0, n, (m, 2)).tolist()
        label = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in label:
            for a, b in edges:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == label


def test_rows_asked_for_needs_no_job_for_each_partition(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    parts = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in parts}
    for k, v in parts.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("asked", "rows asked for")
    try:
        asked = blocks.rows_asked_for(df, df.where("doc_id % 50 = 7"), "doc_id")
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("asked"))
        got = {r.doc_id for r in asked.collect()}
    finally:
        for k in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(k, None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert jobs <= 3
    assert got >= set(range(7, 5000, 50)) and len(got) < 110


def test_pipeline_stages(spark, tmp_path):
    """Every stage on its own input, against what it must do to planted rows."""
    base = [f"the quick brown fox number {i} jumps over lazy dog and runs away from house {i} under water at night {i} again" for i in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[3], "en", "s0", 5), (101, base[3].upper(), "en", "s0", 5), (102, "123 456", "en", "s1", 7), (103, None, "en", "s1", 0),
             (104, "please never show anyone that my token = 'abcdefgh12345678' or else all is lost", "en", "s1", 9), (105, "some words before it " + "leaked question about very secret matters answer is forty two", "en", "s2", 9)]
    bench = [(0, "leaked question about very secret matters answer is forty two")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["language_id"]) == {r[0] for r in rows} - {102, 103}
    assert {100, 101}.isdisjoint(seen["near_duplicates"]) and {3, 105} <= set(seen["near_duplicates"])
    assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - {105}
    assert set(seen["secrets"]) == set(seen["decontamination"])
    assert seen["secrets"][104].text == "please never show anyone that my [assign]' or else all is lost" and seen["secrets"][104].n_chars == 62
    assert all(r.text == rows[d][1] for d, r in seen["secrets"].items() if d < 40)
    assert set(seen["mixture"]) <= set(seen["secrets"]) and len(seen["mixture"]) > 30
