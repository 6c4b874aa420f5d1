import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kinweave.llm import line_dedup, mixing, quality
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def brute_lines(rows, min_sites):
    """rows: (doc_id, text, source) -> texts with cross-site lines removed."""
    sites, first = {}, {}
    for doc, text, source in rows:
        for line in (text or "").split("\n"):
            if re.search("[^\x20\x09-\x0D]", line):
                sites.setdefault(line, set()).add(source or "")
                first[line] = min(first.get(line, doc), doc)
    out = []
    for doc, text, _ in rows:
        kept = [x for x in (text or "").split("\n") if len(sites.get(x, ())) < min_sites or first[x] == doc]
        out.append(None if text is None else "\n".join(kept))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)

    def through(name, df):
        path = str(tmp_path / name.replace(" ", "-"))
        stage[name](spark, df, SF).write.parquet(path)
        return spark.read.parquet(path)

    good = through("quality rules", docs)
    verdicts = {r.doc_id: r.kept for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(d for d, k in verdicts.items() if k)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    base = {r.doc_id: r.base_failed for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert all(verdicts[d] for d, q in labels.items() if q == 1 and not base[d])

    rows = sorted((r.doc_id, r.text, r.source) for r in good.collect())
    lines = through("line dedup", good)
    assert lines.columns == columns
    assert [r.text for r in sorted(lines.collect(), key=lambda r: r.doc_id)] == brute_lines(rows, line_dedup.MIN_SITES)

    rows = sorted((r.doc_id, r.text) for r in lines.collect())
    comps = brute_components([brute_print(t) for _, t in rows])
    near = through("near dedup", lines)
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(rows[c][0] for c in set(comps))

    mixed = through("mixing", near)
    assert mixed.columns == columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, near.collect()))

    texts = {r.doc_id: r.text for r in mixed.collect()}
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True
    ids = {d: [*tokens.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    pieces = stage["packing"](spark, mixed, SF).collect()
    at = dict.fromkeys(ids, 0)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id]
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start:p.start + p.length], "<u4").tobytes())
        at[p.doc_id] += p.length
    assert at == {d: len(x) for d, x in ids.items()}


def test_run_returns_pieces(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]


def test_line_dedup_cases(spark):
    rows = [(i, "shared line\nown %d\n\nshared line" % i, s) for i, s in enumerate(["a", "b", "c", None, "", "e", "f"])]
    rows += [(20, None, "a"), (21, "", "b"), (22, "x\n" * 5, "c"), (6, "shared line\nown 6\n\nshared line", "f"), (23, "two\nlines", "a"), (24, "two", "a")]
    df = spark.createDataFrame([(d, t, s, "n") for d, t, s in rows], "doc_id long, text string, source string, line_hash string").repartition(3)
    for sites in (2, 6, 7):
        got = Counter((r.doc_id, r.text) for r in line_dedup.remove_lines(df, min_sites=sites).collect())
        assert got == Counter(zip([d for d, _, _ in rows], brute_lines(rows, sites)))
    counted = {r.doc_id: (r.a, r.b) for r in line_dedup.remove_lines(df, min_sites=6, n_lines="a", n_removed="b").collect()}
    assert counted[1] == (4, 2) and counted[0] == (4, 0) and counted[20] == (0, 0) and counted[21] == (1, 0)
    assert line_dedup.remove_lines(df.limit(0)).count() == 0
    assert line_dedup.remove_lines(df).columns == df.columns
    for hot in (0, 3, 100):
        got = Counter((r.doc_id, r.text) for r in line_dedup.remove_lines(df, min_sites=6, hot_rows=hot).collect())
        assert got == Counter(zip([d for d, _, _ in rows], brute_lines(rows, 6)))


def test_line_dedup_names_and_null_ids(spark):
    rows = [(i, "same\nown %d" % i, s, 1, "k", 7) for i, s in enumerate("abcde")] + [(None, "same\nown 0", "f", 1, "k", 7), (None, "same\nown 0", "g", 2, "k", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cuts int, d_0 string, n_lines int")
    got = line_dedup.remove_lines(df, n_lines="n_lines", n_removed="cut_doc")
    assert got.columns == ["doc_id", "text", "source", "cuts", "d_0", "n_lines", "cut_doc"]
    assert Counter((r.doc_id, r.text, r.source, r.cuts, r.d_0, r.n_lines, r.cut_doc) for r in got.collect()) == Counter(
        [(0, "same\nown 0", "a", 1, "k", 2, 0), *[(i, f"own {i}", s, 1, "k", 2, 1) for i, s in enumerate("abcde") if i], (None, "own 0", "f", 1, "k", 2, 1), (None, "own 0", "g", 2, "k", 2, 1)])


def test_a_line_in_every_row(spark):
    """One line in every row, another on too few sites, blank lines everywhere, and no broadcast but the hot lines."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, f"every row\n\nrare {i}\n" + "two sites\n" * 2 + "end" * (i % 3), "abcde"[i % 5] if i % 2 else "a") for i in range(600)]
        rows = [(i, t if s in "ab" else t.replace("two sites", f"own {i}"), s) for i, t, s in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
        for hot in (None, 50):
            got = sorted((r.doc_id, r.text) for r in line_dedup.remove_lines(df, hot_rows=hot).collect())
            assert got == list(zip(range(600), brute_lines(rows, 5)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def brute_schedule(counts, weights, block):
    """Slots of each source's blocks by simulating earliest deadline first, slot by slot."""
    total, done, out, t = sum(weights.values()), dict.fromkeys(counts, 0), {}, 0
    left = {s: -(-n // block) for s, n in counts.items()}
    while any(left[s] > done[s] for s in counts):
        ready = [(-(-(done[s] + 1) * total // weights[s]), s) for s in sorted(counts) if done[s] * total // weights[s] <= t]
        deadline, s = min(ready)
        assert t < deadline
        out[s, done[s]] = t
        done[s] += 1
        t += 1
    return {k: v for k, v in out.items() if k[1] < left[k[0]]}


def test_pfair_schedule(spark):
    counts, weights = {"a": 70, "b": 9, "c": 33, "": 5}, {"a": 5, "b": 2, "c": 1}
    rows = [(i, "t", s or None, 0) for i, s in enumerate(x for s, n in counts.items() for x in [s] * n)]
    df = spark.createDataFrame(rows + [(0, "t", "a", 0)], "doc_id long, text string, source string, position int").repartition(3)
    counts["a"] += 1
    got = mixing.schedule(df, weights=weights, block_docs=4).collect()
    names = {s or "\0": n for s, n in counts.items()}
    slots = brute_schedule(names, {**weights, "\0": 1}, 4)
    assert {(r.source or "\0", r.block): r.slot for r in got} == slots
    assert all(r.position == 0 for r in got)  # the table's own column
    assert sorted(r.mix_position for r in got) == list(range(len(rows) + 1))
    assert [r.slot for r in sorted(got, key=lambda r: r.mix_position)] == sorted(r.slot for r in got)
    assert all(r.release <= r.slot < r.deadline for r in got)
    shares, seen = {"a": 5 / 9, "b": 2 / 9, "c": 1 / 9, "\0": 1 / 9}, Counter()
    for (s, _), t in sorted(slots.items(), key=lambda x: x[1]):
        seen[s] += 1
        if t < 9:
            assert all(abs(seen[x] - shares[x] * (t + 1)) < 1 for x in shares)
    mixed = mixing.interleave(df, weights=weights)
    assert mixed.columns == df.columns and mixed.count() == len(rows) + 1
    want = [(r.doc_id, r.source) for r in sorted(got, key=lambda r: r.mix_position)]
    assert [(r.doc_id, r.source) for r in mixing.interleave(df, weights=weights, block_docs=4).collect()] == want
    assert mixing.schedule(df.limit(0)).count() == 0 and mixing.interleave(df.limit(0)).count() == 0
    assert mixing.schedule(df).count() == len(rows) + 1


def test_pfair_many_sources(spark):
    """Weights that many sources share, against slot-by-slot simulation; then 5,000 sources at once."""
    r = random.Random(3)
    for sources in (1, 7, 40):
        weights = {f"s{i:02d}": r.choice([1, 2, 3, 7]) for i in range(sources)}
        counts = {s: r.randrange(1, 40) for s in weights}
        df = spark.createDataFrame([(i, "t", s) for i, s in enumerate(x for s, n in counts.items() for x in [s] * n)], "doc_id long, text string, source string")
        got = mixing.schedule(df, weights=weights, block_docs=3).collect()
        assert {(x.source, x.block): x.slot for x in got} == brute_schedule(counts, weights, 3)
        assert sorted(x.position for x in got) == list(range(sum(counts.values())))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), F.col("id") % 5000).alias("source"))
    found = mixing.schedule(many)
    assert found.agg(F.count_distinct("position"), F.max("position"), F.count_distinct("slot")).first()[:] == (20_000, 19_999, 5000)


def test_period_by_the_common_divisor(spark):
    weights = spark.createDataFrame([("a", 200_000), ("b", 400_000), ("c", 200_000)], "src string, weight long")
    rows = mixing._period(weights).orderBy("slot").collect()
    plain = mixing._period(spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "src string, weight long")).orderBy("slot").collect()
    assert rows == plain and len(rows) == 4


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0 if name == "documents" else 50).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
