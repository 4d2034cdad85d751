import json
import math
import glob
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from shortlist.functions.vectors import cosine, cosine_arrow, decode_vector, encode_vector, l2_normalise
from shortlist.operators import embed as ops
from shortlist.operators.embed import BatchVectoriser, HashedWords
from shortlist.operators.match import best_rows, first_share, match_profiles, tasks_for
from shortlist.operators.profile import profile_skills, profile_text
from shortlist.operators.ranking import cosine_scores, score_bounds, tier_hits_at_k, tier_quality
from shortlist.plans.rank import fetch_rows, rank_file, rank_frame, with_address
from shortlist.plans.refresh import refresh_vectors, write_vector_table
from shortlist.plans.score import embed_postings, profile_row
from shortlist.sources.ingest import scan_postings, scan_profiles

HERE = os.path.join(os.path.dirname(__file__), "fixtures")
numbers = st.lists(st.lists(st.floats(-100, 100, width=32), min_size=4, max_size=4), min_size=1, max_size=10)


@settings(max_examples=5, deadline=None)
@given(numbers)
def test_cosine_is_bounded_and_symmetric(spark, rows):
    target = rows[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<float>")
    for i, v, a, b in df.select("i", "v", cosine("v", target), cosine_arrow("v", target)).collect():
        assert -1 - 1e-9 <= a <= 1 + 1e-9 and abs(a - b) < 1e-9
        back = df.filter(F.col("i") == 0).select(cosine("v", list(v))).first()[0]
        assert abs(a - back) < 1e-9


def test_normalise_and_text_form(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(l2_normalise("v")).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0], None]
    vector = [0.054249506, -1e-9, 3.5]
    text = spark.createDataFrame([(vector,)], "v array<float>").select(encode_vector("v")).first()[0]
    parsed = spark.createDataFrame([(text,), ("oops",), ("[1, null]",), ('[1,"x"]',), ("[]",), (None,)], "t string").select(decode_vector("t"))
    got = [r[0] for r in parsed.collect()]
    assert np.allclose(got[0], np.float32(vector)) and got[1:] == [None] * 5


def test_match_against_brute_force_in_slices(spark):
    rng = np.random.default_rng(3)
    posts = rng.normal(size=(400, 8)).astype(np.float32)
    posts[100:250] = posts[7]                       # many copies of one vector
    people = rng.normal(size=(30, 8)).astype(np.float32)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(posts)] + [(999, None)], "id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(people)], "profile_id long, embedding array<float>")
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    scores = np.round(unit(people) @ unit(posts).T, 6)
    want = {i: sorted(range(400), key=lambda j: (-scores[i, j], j))[:12] for i in range(30)}
    for limit in (10 ** 6, 80):                     # one pass, and several
        got = {}
        for r in match_profiles(p, q, 12, max_floats=limit).orderBy("profile_id", "rank").collect():
            got.setdefault(r["profile_id"], []).append(r["id"])
        assert got == want
    assert match_profiles(p, q.filter("profile_id < 0")).count() == 0


def test_matching_sends_rows_by_profile_and_not_by_task(spark):
    draw = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(6400, 8)))],
                                 "id long, embedding array<double>").repartition(64)
    matrix = draw.normal(size=(20, 8))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    names, k, schema = list(range(20)), 5, "profile_id long, id long, score double"
    some = first_share(rows)
    assert some.rdd.getNumPartitions() == 8 and 600 < some.count() < 1000
    open_ends = best_rows(rows, names, matrix, np.full(20, -np.inf), k, schema)
    assert open_ends.count() == 64 * 20 * k
    early = best_rows(some, names, matrix, np.full(20, -np.inf), k, schema).toPandas()
    bounds = np.array([early[early.profile_id == p].score.nlargest(k).min() for p in names])
    assert best_rows(rows, names, matrix, bounds, k, schema).count() < 64 * 20 * k / 3


def test_matching_by_tiles_against_brute_force(spark):
    """Postings in one partition are dealt out; copies, null ids and a vector that is no number take nothing from the others."""
    draw = np.random.default_rng(5)
    posts, people = draw.normal(size=(9000, 16)), draw.normal(size=(600, 16))
    posts[1000:1400] = posts[3]
    people[1] = 2 * posts[3]
    posts[2000:2010] = people[0] * draw.uniform(1, 2, size=(10, 1))        # ties but for rounding
    names = [None if i in (1100, 1200) else f"p{i}" for i in range(9000)]
    p = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, posts, strict=True)] + [("nan", [float("nan")] * 16)],
                              "id string, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(people)], "profile_id string, embedding array<double>")
    assert tasks_for(p) == 9
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(people) @ unit(posts).T, 12)
    place = np.array([n or "" for n in names])
    want = {f"v{i}": [names[j] for j in np.lexsort((place, -scores[i]))[:4]] for i in range(600)}
    got = {}
    for r in match_profiles(p, q, 4).orderBy("profile_id", "rank").collect():
        got.setdefault(r["profile_id"], []).append(r["id"])
    assert got == want and any(None in x for x in want.values())


def test_matching_refuses_vectors_of_other_lengths(spark):
    four = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (9, None)], "profile_id long, embedding array<double>")
    even = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0] * 6)], "id long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="another length than 4: [26]"):
        match_profiles(even, four).collect()
    both = four.unionByName(spark.createDataFrame([(2, [1.0, 0.0])], "profile_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="2 and 4"):
        match_profiles(even, both)
    ties = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0]) for i in range(200, 0, -1)] + [(0, None)], "id long, embedding array<double>").repartition(9)
    assert [r["id"] for r in match_profiles(ties, four, 7).orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6, 7]


def test_hashed_words_against_counting(spark):
    words = HashedWords(dims=32, stop_words=False)
    text = "The red Ring, the RED ring; c++ and C#"
    df = spark.createDataFrame([(text,), ("",), (None,), ("...",)], "t string")
    rows = [r["embedding"] for r in ops.embed(df, "t", words).collect()]
    tf = HashingTF(numFeatures=32)
    want = np.zeros(32)
    for token in ["the", "red", "ring", "the", "red", "ring", "c++", "and", "c#"]:
        want[tf.indexOf(token)] += 1
    assert np.allclose(rows[0], want / np.linalg.norm(want), atol=1e-6)
    assert rows[1] == [0.0] * 32 and rows[2] is None and rows[3] == [0.0] * 32


def test_only_stale_rows_reach_the_model(spark):
    def load():
        def model(texts):
            assert "cached" not in texts
            return np.array([[len(t), 1.0] for t in texts])
        return model

    mine = BatchVectoriser("mine", load, batch=2)
    df = spark.createDataFrame(
        [(1, "cached", [9.0, 9.0], "mine"), (2, "abc", [1.0, 1.0], "other"), (3, "abcd", None, "mine"), (4, "x", [1.0, 0.0], None), (5, None, None, None)],
        "id long, t string, embedding array<float>, embedding_model string")
    out = {r["id"]: r for r in ops.embed_incremental(df, mine, "t").collect()}
    assert [out[i]["embedded_now"] for i in (1, 2, 3, 4, 5)] == [False, True, True, True, True]
    assert out[1]["embedding"] == [9.0, 9.0] and out[2]["embedding"] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])
    assert out[5]["embedding"] is None and {r["embedding_model"] for r in out.values()} == {"mine"}
    row = ops.embedding_coverage(df, "mine").first()
    assert (row["embedded"], row["skipped_cached"]) == (4, 1)
    assert ops.embedding_coverage(df.drop("embedding", "embedding_model"), "mine", force=True).first()["embedded"] == 5
    bare = ops.stale_embeddings(df.select("id", "t"), "mine")
    assert bare.filter("stale").count() == 5


def test_vectors_of_unchanged_texts_are_reused(spark):
    schema = "id long, t string, embedding array<float>, embedding_model string"
    old = spark.createDataFrame([(1, "same", [1.0], "m"), (2, "before", [2.0], "m")], schema)
    new = spark.createDataFrame([(1, "same"), (2, "after"), (3, "new")], "id long, t string")
    out = {r["id"]: r["embedding"] for r in ops.reuse_vectors(new, old, "t").collect()}
    assert out == {1: [1.0], 2: None, 3: None}


def plain_profile_text(p):
    """The weighting rule, written out for one profile."""
    parts = [p["summary"]["headline"], p["summary"]["elevator_pitch"]]
    for items in p["technical_skills"].values():
        parts += [" ".join(items)] * 2
    for role in p["experience"]:
        parts += [f"{role['role']} at {role['company']}", role.get("summary", "")]
        for done in role.get("achievements", []):
            parts += [done["description"], done["impact"]]
        parts += role.get("tech_used", [])
    parts += p["ats_keywords_pool"] * 2 + p["open_roles_targeted"]["primary"] + p["open_roles_targeted"]["secondary"]
    return " ".join(" ".join(x for x in parts if x).split())


def test_profile_text_and_skills(spark):
    path = os.path.join(HERE, "profile.json")
    profile = scan_profiles(spark, path)
    text = profile_text(profile).first()["profile_text"]
    assert text == plain_profile_text(json.load(open(path))) and len(text) > 200
    skills = profile_skills(profile).first()["profile_skills"]
    assert {"abaqus", "mig welding", "leica", "steel"} <= set(skills) and skills == sorted(set(skills))
    short = profile_text(profile, roles=4).first()["profile_text"]
    assert "Apprentice welder" in text and "Apprentice welder" not in short


def test_empty_profile(spark):
    profile = scan_profiles(spark, os.path.join(HERE, "profile.json")).select(
        *[F.lit(None).cast(kind).alias(name) for name, kind in scan_profiles(spark, os.path.join(HERE, "profile.json")).dtypes])
    row = profile_skills(profile_text(profile)).first()
    assert row["profile_text"] == "" and row["profile_skills"] == []


def test_ranking_quality_gates(spark):
    profile = scan_profiles(spark, os.path.join(HERE, "profile.json"))
    jobs = scan_postings(spark, os.path.join(HERE, "jobs.csv"))
    words = HashedWords()
    me = profile_row(profile, words)
    scored = embed_postings(jobs, words).withColumn("similarity_score", cosine("embedding", me["vector"])).withColumn(
        "id", F.monotonically_increasing_id())
    assert all(r["passes"] for r in tier_quality(scored).collect())
    assert tier_hits_at_k(scored, 10).first()["passes"]
    assert tuple(score_bounds(scored).first()) == (0, 0)


def test_rank_file(spark):
    profile = scan_profiles(spark, os.path.join(HERE, "profile.json"))
    out = rank_file(spark, os.path.join(HERE, "jobs.csv"), profile, HashedWords(), n=5)
    assert out.top.count() == 5 and out.summary.first()["total_scored"] == 12 and out.digest.count() == 6
    assert out.short_texts.first()["total"] == 12 and out.tokens.first()["percent"] > 0
    assert rank_frame(scan_postings(spark, os.path.join(HERE, "jobs.csv")), profile, HashedWords(), 5, min_score=0.99).top.count() == 0


def test_rank_file_fetches_the_best_rows_by_address(spark, tmp_path):
    profile = scan_profiles(spark, os.path.join(HERE, "profile.json"))
    rows = spark.createDataFrame([(f"t{i % 40}", f"c{i % 3}", f"data engineer python {'x ' * (i % 50)} spark " * 4, {"a": str(i % 40)}) for i in range(200)],
                                 "title string, company string, description_text string, extra map<string,string>")
    for part in range(8):
        rows.filter(F.pmod(F.xxhash64("title"), F.lit(8)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "jobs"))
    out = rank_file(spark, str(tmp_path / "jobs"), profile, HashedWords(), n=7, fmt="parquet")
    assert not {"description_text", "embedding", "clean_text", "extra"} & set(out.scored.columns)        # nothing wide is staged
    got = [(r["title"], r["company"], round(r["similarity_score"], 9)) for r in out.top.collect()]
    whole = cosine_scores(embed_postings(rows, HashedWords()), profile_row(profile, HashedWords())["vector"])
    want = sorted(((r["title"], r["company"], round(r["similarity_score"], 9)) for r in whole.collect()), key=lambda r: (-r[2], r[0], r[1]))
    assert sorted(got) == sorted(want[:7]) and "description_text" in out.top.columns
    # repeated rows have one address and stay as often as they rank
    twins = rows.limit(1).unionByName(rows.limit(1)).unionByName(rows.limit(1))
    assert rank_frame(twins, profile, HashedWords(), 2).top.count() == 2 and rank_frame(twins, profile, HashedWords(), 9).top.count() == 3


def test_only_files_of_found_rows_are_read_again(spark, tmp_path):
    for i in range(5):
        spark.createDataFrame([(f"t{i}", "x")], "title string, company string").coalesce(1).write.mode("append").csv(str(tmp_path / "c"), header=True)
    rows = scan_postings(spark, str(tmp_path / "c"), multi_line=False, file="_file")
    found = with_address(rows).filter("title = 't3'").withColumn("similarity_score", F.lit(1.0))
    fetched = fetch_rows(rows, found)
    assert [(r["title"], r["similarity_score"]) for r in fetched.collect()] == [("t3", 1.0)]
    one = found.first()["_file"]
    assert len(rows.filter(F.col("_file").isin([one])).inputFiles()) >= 1
    plan = rows.filter(F.col("_file").isin([one]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_metadata" in plan or "file_path" in plan


def test_refresh_writes_only_outdated_partitions(spark, tmp_path):
    path, old, new = str(tmp_path / "table"), HashedWords(dims=8), HashedWords(dims=16)
    rows = spark.createDataFrame([(i, f"text number {i}" if i % 10 else None) for i in range(200)], "id long, t string")
    write_vector_table(ops.embed(rows, "t", new), path, parts=12)
    base = spark.read.parquet(path)
    assert refresh_vectors(spark, path, new, "t").count() == 0      # rows without text are not due for ever
    # three rows fall back to the other model, in as many partitions as they hash to
    stale = F.col("id").isin(3, 14, 77)
    both = base.withColumn("embedding_model", F.when(stale, old.name).otherwise(F.col("embedding_model")))
    path = str(tmp_path / "again")
    write_vector_table(both.drop("part"), path, parts=12)
    hit = {r["part"] for r in spark.read.parquet(path).filter(stale).select("part").distinct().collect()}
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}
    report = {r["part"]: r["renewed"] for r in refresh_vectors(spark, path, new, "t").collect()}
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}
    assert set(report) == hit and sum(report.values()) == 3 and 1 <= len(hit) <= 3
    same = {f for f in after if before.get(f) == after[f]}
    assert {int(re.search(r"part=(\d+)", f)[1]) for f in set(after) - same} == hit and len(same) == len(before) - len(hit)
    out = spark.read.parquet(path)
    assert out.count() == 200 and out.filter(F.col("embedding_model") != new.name).count() == 0
    want = {r["id"]: r["embedding"] for r in ops.embed(rows, "t", new).collect()}
    assert {r["id"]: r["embedding"] for r in out.collect()} == want
    assert refresh_vectors(spark, path, new, "t").count() == 0 and refresh_vectors(spark, path, old, "t").count() == len(before)


def test_large_partitions_of_a_vector_table_are_split_over_tasks(spark, tmp_path):
    old, new, size = HashedWords(dims=8), HashedWords(dims=16), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(20_000).select("id", F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 512)).alias("t")).repartition(16)
    path, before = str(tmp_path / "table"), spark.conf.get(size)
    spark.conf.set(size, "100k")
    try:
        write_vector_table(ops.embed(rows, "t", old), path, parts=2)
        files = [glob.glob(f"{path}/part={i}/*.parquet") for i in range(2)]
        assert min(map(len, files)) > 2
        assert sum(r["renewed"] for r in refresh_vectors(spark, path, new, "t").collect()) == 20_000
    finally:
        spark.conf.set(size, before)
    again = [glob.glob(f"{path}/part={i}/*.parquet") for i in range(2)]
    assert min(map(len, again)) > 2 and not set(sum(again, [])) & set(sum(files, []))
    out = spark.read.parquet(path)
    assert out.count() == out.select("id").distinct().count() == 20_000 and out.filter(F.col("embedding_model") != new.name).isEmpty()
