"""Packing, mixing, license scans, token counts, the pipeline, and the SQL of this subpackage."""

import random
import struct
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import llm_brute as brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swipeline.llm import queries
from swipeline.llm.licenses import license_scan
from swipeline.llm.mixing import mix, mix_documents
from swipeline.llm.packing import pack
from swipeline.llm.token_counts import TokenRollup, document_counts
from swipeline.llm.toxicity import toxicity


@pytest.fixture(scope="module")
def exact_ids():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*whole.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(pieces, docs, ids_of):
    """Every id once, in its place; windows full or powers of two; no gaps."""
    by_doc, by_seq = brute.groups(((p["doc_id"], p["doc_tokens"]), p) for p in pieces), brute.groups((p["sequence_id"], p) for p in pieces)
    want = Counter(tuple(ids_of(t)) for _, t in docs)
    assert sum(p["length"] for p in pieces) == sum(len(k) * n for k, n in want.items())
    for i, t in docs:
        ids = ids_of(t)
        own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in by_doc[i, len(ids)])
        if [n for n, _ in docs].count(i) == 1:
            assert sum(x[1] for x in own) == len(ids)
            at = 0
            for start, length, crc in own:
                assert start == at and crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
                at += length
    for own in by_seq.values():
        own = sorted((p["offset"], p["length"]) for p in own)
        at = 0
        for offset, length in own:
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_packing_query(spark, exact_ids):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{brute.SF}/documents.parquet").collect()]
    check_packing(queries.op2_packing(spark, brute.SF).collect(), docs, exact_ids)


@pytest.mark.parametrize("most_open", [2, 1024])
def test_packing_edges(spark, exact_ids, most_open):
    rows = brute.edge_rows()
    out = pack(brute.table(spark, rows).repartition(2), most_open=most_open).withColumn("ids_crc32", F.crc32("ids"))
    check_packing(out.collect(), [(i, t) for i, t, _ in rows], exact_ids)
    assert pack(brute.table(spark, [])).count() == 0


def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", [brute.SF, "/root/testdata/sf0.01"])
def test_sql(spark, name, sf):
    got = queries.QUERIES[name](spark, sf)
    rel = duck(sf).sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(rel.select(", ".join(cols)).fetchall())


def test_mixing_targets(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(10, "a"), (400, "b"), (30, "c"), (50, None), (0, "e")])]
    out = {r.source: r for r in mix(brute.table(spark, rows)).collect()}
    # 735 to share; weights 3, 1, 2, 3, 1: a, c and None stop at 20, 60 and 100, so b takes the rest; e is empty
    assert [out[s].target for s in ("a", "b", "c", None, "e")] == [20, 555, 60, 100, 0]
    assert [out[s].taken for s in ("a", "b", "c", None, "e")] == [20, 555, 60, 100, 0]


def test_mixing_edges(spark):
    docs = brute.table(spark, brute.edge_rows())
    plan = mix(docs).collect()
    assert len(plan) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in plan)
    for own in brute.groups((r.source, r) for r in plan).values():
        assert sum(r.taken for r in own) == round(own[0].target) and sum(r.size for r in own) == own[0].source_size
    rows = mix_documents(docs)
    assert rows.columns == docs.columns
    got, want = Counter(), Counter()
    for r in rows.collect():
        got[r.doc_id, r.source] += len(brute.words(r.text))
    for r in plan:
        want[r.doc_id, r.source] += r.taken
    assert got == +want
    assert mix(docs.filter("false")).count() == mix_documents(docs.filter("false")).count() == 0
    nothing = brute.table(spark, [(1, None, "a"), (2, "", None)])
    assert [(r.taken, r.target) for r in mix(nothing).collect()] == [(0, 0.0)] * 2 and mix_documents(nothing).count() == 0


def test_mixing_repeated_rows(spark):
    rows = [(1, "a b c d", "s")] * 3 + [(2, "x y", "s"), (3, None, None), (None, "p q r", None)]
    docs = brute.table(spark, rows)
    for share in (0.4, 0.8, 1.2, 1.7):
        taken = sum(r.taken for r in mix(docs, share=share).collect())
        assert taken == sum(len(r.text.split()) for r in mix_documents(docs, share=share).collect())


def test_licenses(spark):
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    rows = [
        (1, "Intro line\nReleased under the MIT License. More prose follows here.", "s"),
        (2, "This work is licensed under the GNU General Public License, version 3.", "s"),
        (3, "This work is licensed under the GNU General Public License, version 2.", "s"),
        (4, grant.replace("modification", "changes"), "s"),
        (5, "No notice; the software they wrote has a permission dialog about something else.", "s"),
        (6, "Licensed under CC BY-SA 4.0. All rights reserved.", "s"), (7, None, "s"), (8, "", None), (None, "Licensed under CC0 1.0.", "s"),
        (9, "word " * 20000 + "released under the mit license. " + "other " * 20000, "s"),
    ]
    out = license_scan(brute.table(spark, rows)).collect()
    sure = {(r.doc_id, r.license) for r in out if r.confirmed}
    assert sure == {(1, "MIT"), (2, "GPL-3.0"), (3, "GPL-2.0"), (4, "BSD-2-Clause OR BSD-3-Clause"), (6, "CC-BY-SA-4.0"), (6, "All-rights-reserved"), (None, "CC0-1.0"), (9, "MIT")}
    one = next(r for r in out if r.doc_id == 4 and r.confirmed)
    assert one.differences == ["-modification +changes"] and (one.missing_words, one.added_words) == (1, 1) and one.reduction > 0.2
    assert next((r.block, r.start_word, r.end_word) for r in out if r.doc_id == 1) == (1, 0, 5)
    assert license_scan(brute.table(spark, [])).count() == 0


def test_many_notices_in_one_line(spark):
    """A line of many notices takes time in proportion, and each is found where it is."""
    notice, n = "Licensed under CC BY-SA 4.0. All rights reserved. ", 400
    out = license_scan(brute.table(spark, [(1, notice * n, "s"), (2, "the software and " * 20000, "s")])).filter("confirmed").collect()
    assert sorted((r.start_word, r.license) for r in out if r.doc_id == 1) == sorted(x for k in range(n) for x in ((8 * k, "CC-BY-SA-4.0"), (8 * k + 5, "All-rights-reserved")))
    assert not [r for r in out if r.doc_id == 2]


def test_license_query_whole(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = queries.op1_license_scan(spark, "/root/testdata/sf0.01").filter("confirmed").collect()
    for phrase, name in (("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("All rights reserved.", "All-rights-reserved")):
        assert {i for i, t in docs.items() if phrase in t} <= {r.doc_id for r in out if r.license == name}


def test_token_rollup(spark, tmp_path, exact_ids):
    rows = brute.edge_rows()
    docs = brute.table(spark, rows)
    counted = document_counts(docs).withColumn("op", F.lit("insert"))
    assert sorted(r.tokens for r in counted.collect()) == sorted(len(exact_ids(t)) - 1 for _, t, _ in rows)
    rollup = TokenRollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    rollup.commit(0, counted)
    changes = spark.createDataFrame([(7, "delete", None, None, None, None), (11, "revise", "z", "fr", "v2", 5), (999, "delete", None, None, None, None), (50, "insert", None, None, None, 3), (None, None, "q", "q", "q", 1)], "doc_id long, op string, source string, lang string, tokenizer string, tokens long")
    rollup.commit(1, changes)
    want = Counter()
    for i, t, s in rows:
        if i not in (7, 11):
            want[s, "en", "byte_bpe_50k/1", "docs"] += 1
            want[s, "en", "byte_bpe_50k/1", "tokens"] += len(exact_ids(t)) - 1
    want.update({("z", "fr", "v2", "docs"): 1, ("z", "fr", "v2", "tokens"): 5, (None, None, None, "docs"): 1, (None, None, None, "tokens"): 3})

    def totals():
        return +Counter({(r.source, r.lang, r.tokenizer, c): r[c] for r in rollup.totals().collect() for c in ("docs", "tokens")})

    assert totals() == +want
    rollup.commit(1, changes)
    rollup.commit(0, counted)
    assert totals() == +want
    rollup.commit(2, changes.filter("false"))
    assert totals() == +want
    with pytest.raises(ValueError, match="batch 1"):
        rollup.commit(1, changes.filter("doc_id = 7"))
    rollup.compact()
    rollup.commit(1, changes)
    assert totals() == +want
    with pytest.raises(ValueError, match="batch 2"):
        rollup.commit(2, changes)
    rollup.commit(3, spark.createDataFrame([(50, "delete")], "doc_id long, op string"))
    assert totals() == +want - Counter({(None, None, None, "docs"): 1, (None, None, None, "tokens"): 3})


def test_token_rollup_replays_against_plain_totals(spark, tmp_path, monkeypatch):
    """Random batches, the last one given again with other counts, an older one with others refused, and commits that fail half-way."""
    draw, rollup, log = random.Random(4), TokenRollup(spark, str(tmp_path / "r")), []

    def batch():
        return [(draw.randrange(12), draw.choice(["insert", "delete", "revise"]), draw.choice("ab"), draw.choice(["en", None]), "v", draw.randrange(100)) for _ in range(8)]

    def plain():
        held = {}
        for rows in log:
            gone = {r[0] for r in rows if r[1] != "insert"}
            held = {i: x for i, x in held.items() if i not in gone}
            for i, op, source, lang, version, n in rows:
                if op != "delete":
                    held.setdefault(i, []).append((source, lang, version, n))
        want = Counter()
        for own in held.values():
            for source, lang, version, n in own:
                want[source, lang, version, "docs"] += 1
                want[source, lang, version, "tokens"] += n
        return +want

    def totals():
        return +Counter({(r.source, r.lang, r.tokenizer, c): r[c] for r in rollup.totals().collect() for c in ("docs", "tokens")})

    table = lambda rows: spark.createDataFrame(rows, "doc_id long, op string, source string, lang string, tokenizer string, tokens long")
    for k in range(3):
        for rows in (batch(), batch()):
            log[k:] = [rows]
            rollup.commit(k, table(rows))
            rollup.commit(k, table(rows[::-1]))
            assert totals() == plain()
    with pytest.raises(ValueError):
        rollup.commit(0, table(batch()))
    with monkeypatch.context() as m:
        m.setattr(TokenRollup, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            rollup.commit(3, table(batch()))
    assert totals() == plain()
    log.append(batch())
    rollup.commit(3, table(log[3]))
    assert totals() == plain()


def test_token_rollup_reads_no_more_with_more_batches(spark, tmp_path):
    """Manifests, folders and entries stay few, replays of any batch stay known, and a commit reads only its documents' parts."""
    path = str(tmp_path / "r")
    rollup, tokens = TokenRollup(spark, path, parts=8, most_live=3, grace_s=0), 0
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, op string, source string, tokens long")
    batches = [[(k, "insert", "a", 10 + k), (100 + k, "insert", "b", 1), *([(k - 3, "revise", "c", 7)] if k >= 3 else [])] for k in range(11)]
    for k, rows in enumerate(batches):
        rollup.commit(k, table(rows))
        entries = rollup.entries()
        assert len(entries) <= 5 and len(rollup.manifests()) <= 4
    assert all(len(rollup.listed(f"{path}/{kind}")) <= len(entries) for kind in ("deltas", "sums", "marks"))
    totals = lambda: {r.source: (r.docs, r.tokens) for r in rollup.totals().collect()}
    want = {"a": (3, sum(10 + k for k in (8, 9, 10))), "b": (11, 11), "c": (8, 56)}
    assert totals() == want
    for k in (0, 5, 10):
        rollup.commit(k, table(batches[k][::-1]))
    with pytest.raises(ValueError, match="batch 4"):
        rollup.commit(4, table(batches[5]))
    assert totals() == want
    rollup.commit(10, table(batches[10][:1]))  # the last one may still be given anew
    assert totals() == {"a": (4, 17 + 18 + 19 + 20), "b": (10, 10), "c": (7, 49)}
    rollup.compact()
    assert len(rollup.entries()) == 1 and totals()["b"] == (10, 10)
    read = rollup.read("deltas", "doc_id long, part int", rollup.entries()).filter(F.col("part").isin([3]))
    assert "PartitionFilters: [isnotnull(part#" in read._jdf.queryExecution().executedPlan().toString()


def test_token_query(spark, exact_ids):
    read = lambda t: spark.read.parquet(f"{brute.SF}/{t}.parquet").collect()
    docs, labels = read("documents"), read("labels")
    toxic, poor = {r.doc_id for r in labels if r.toxic == 1}, {r.doc_id for r in labels if r.quality == 0}
    want = Counter()
    for r in docs:
        if r.doc_id not in toxic:
            text = "".join(c for c in r.text or "" if c not in "!*$%&#|") if r.doc_id in poor else r.text
            want[r.source, r.lang] += len(exact_ids(text)) - 1
    assert {(r.source, r.lang): r.tokens for r in queries.op9_token_counts(spark, brute.SF).collect()} == dict(want)


def test_pipeline(spark, exact_ids):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    labels = spark.read.parquet(f"{brute.SF}/labels.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["toxicity", "exact dedup", "simhash dedup", "mixing", "packing"]
    clean = by_name["toxicity"](spark, docs, brute.SF).cache()
    want = {r.doc_id for r in toxicity(docs, labels).filter("predicted = 0").collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want and 0 < len(want) < docs.count()
    single = by_name["exact dedup"](spark, clean, brute.SF).cache()
    same = brute.groups((brute.lower(r.text), r.doc_id) for r in clean.collect())
    assert {r.doc_id for r in single.collect()} == {max(x) for x in same.values()}
    near = by_name["simhash dedup"](spark, single, brute.SF).cache()
    prints = {r.doc_id: brute.fingerprint(r.text) for r in single.collect()}
    ids = sorted(prints)
    roots = brute.components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {r.doc_id for r in near.collect()} == set(roots.values())
    mixed = by_name["mixing"](spark, near, brute.SF).cache()
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(brute.words(r.text))
    assert got == +Counter({r.doc_id: r.taken for r in mix(near).collect()}) and mixed.columns == docs.columns
    whole = Counter(i for r in mixed.collect() for i in exact_ids(r.text))
    pieces = corpus_pipeline.run(spark, brute.SF).collect()
    assert sum(whole.values()) == sum(p["length"] for p in pieces)
    assert whole == Counter(i for p in pieces for i in struct.unpack(f"<{p['length']}I", p["ids"]))


def test_pipeline_shared_ids_and_clashing_columns(spark, tmp_path, exact_ids):
    """All stages on rows that share or lack ids, with columns named like the operators' own: each stage keeps what it should, values unchanged."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (None, c, None), (9, None, "s"), (9, "", "s"), (5, b.upper(), "s")]
    more = {"score": 0.25, "held_out": True, "predicted": 7, "kept": False, "keep_id": 77, "group_size": 99, "_id": 5, "_taken": 3}
    docs = brute.table(spark, rows)
    docs = docs.withColumns({k: F.lit(v) for k, v in more.items()})
    spark.read.parquet(f"{brute.SF}/labels.parquet").filter("false").write.parquet(str(tmp_path / "labels.parquet"))
    out, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / f"stage{len(kept)}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        kept.append(out.collect())
        assert all(r[k] == v for r in kept[-1] for k, v in (brute.CLASHING | more).items())
    assert len(kept[0]) == 7
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept[1]) == [(0, len(c)), (5, len(a)), (5, len(b)), (9, 0)]
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept[2]) == [(0, len(c)), (5, len(a)), (5, len(b)), (9, 0)]
    assert {r.doc_id for r in kept[3]} == {5, None} and sum(len(r.text.split()) for r in kept[3]) == round(202.5 + 0.1) + round(67.5 + 0.1)  # two budgets, rounded up
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect()
    assert sum(p["length"] for p in pieces) == sum(len(exact_ids(r.text)) for r in kept[3])


def test_pipeline_empty(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{brute.SF}/{t}.parquet").filter("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
