"""Worked values, sources, sinks and streaming."""

import json
import re

import pytest
from pyspark.sql import functions as F

from cairnwatch.functions import segments
from cairnwatch.functions import text as tx
from cairnwatch.operators import classifier, fusion, graph, metrics, patterns, quality, scorers, snapshot, windows
from cairnwatch.operators.patterns import Hop, Pattern
from cairnwatch.plans import dims, relational, scoring
from cairnwatch.sources import catalogs, sinks
from cairnwatch.streaming import requests


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def confidence(df, technique):
    return next(r.confidence for r in df.collect() if r.technique_id == technique)


@pytest.mark.parametrize("n, want", [(1, 0.5), (2, 0.6), (5, 0.9), (6, 0.9)])
def test_rule_v1_score(spark, n, want):
    words = [f"kw{c}" for c in "abcdef"[:n]]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert confidence(scorers.rule_v1(docs, [("T1", w) for w in words]), "T1") == want


def test_chunk_merge_past_a_thousand_chunks(spark, tmp_path):
    long = "xyz " * 1_127_000 + "powershell"  # in chunk 1,001 or so
    spark.createDataFrame([(1, long), (2, "vpn")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.technique_id): r.n_chunks for r in scoring.chunk_merge(spark, str(tmp_path)).collect()}
    assert got == {(1, "T1059.001"): 1, (2, "T1133"): 1}


@pytest.mark.parametrize("u, count, only, boost, first, last, n, want", [
    (1, 1, False, 1.0, None, None, 1, 0.48), (2, 2, True, 0.8, None, None, 0, 0.32), (2, 3, False, 1.2, 0, 80, 3, 0.80772),
])
def test_rule_v2_score(spark, u, count, only, boost, first, last, n, want):
    row = (["k"] * 0 + [f"k{i}" for i in range(u)], count, only, boost, first, last, n)
    df = spark.createDataFrame([row], "keywords array<string>, match_count int, context_only boolean, boost double, first int, last int, n_positions int")
    assert scorers.score_v2(df).first().confidence == pytest.approx(want, abs=1e-5)


def test_rule_v2_counts_overlaps(spark):
    docs = spark.createDataFrame([(1, "thathat xx nothing")], "doc_id long, text string")
    assert scorers.rule_v2(docs, [("T1", "that")]).first().match_count == 2


def test_bm25_worked_values(spark):
    corpus = spark.createDataFrame([("a", "powershell script"), ("b", "phishing email script")], "row_id string, body string")
    docs = spark.createDataFrame([(1, "powershell script script")], "doc_id long, text string")
    raw = {r.row_id: r.raw for r in scorers.bm25_v1(docs, corpus).collect()}
    assert raw["a"] == pytest.approx(4.007941, abs=1e-5) and raw["b"] == pytest.approx(2.653515, abs=1e-5)
    fields = spark.createDataFrame([("a", "A", "name", 3.0, "powershell script"), ("b", "B", "keyword", 2.0, "phishing email script")], "row_id string, technique_id string, field string, weight double, body string")
    docs = spark.createDataFrame([(1, "powershell script")], "doc_id long, text string")
    raw = {r.technique_id: r.raw for r in scorers.bm25_v2(docs, fields).collect()}
    assert raw["A"] == pytest.approx(8.886161, abs=1e-5) and raw["B"] == pytest.approx(4.334535, abs=1e-5)


def test_large_vocabularies_are_joined(spark):
    docs = spark.createDataFrame([(1, "A b\u00a0b\tc"), (2, None), (3, "")], "doc_id long, text string")
    words = spark.createDataFrame([("a",), ("b",), ("x",)], "term string")
    here, joined = (sorted(map(tuple, scorers.query_terms(docs, words, most).collect())) for most in (10, 1))
    assert here == joined == [(1, "a", 1), (1, "b", 2)]


CANDIDATE = "doc_id long, technique_id string, extractor string, confidence double, has_cve boolean, n_keywords int"


@pytest.mark.parametrize("rows, want", [
    ([("rule_based", 0.6, False, 1), ("bm25", 1.0, False, 1)], 0.732), ([("kev", 0.9, True, 0)], 0.98325), ([("rule_based", 0.8, False, 4)], 0.616),
])
def test_combine_weighted(spark, rows, want):
    df = spark.createDataFrame([(1, "T1", *r) for r in rows], CANDIDATE)
    assert fusion.combine_weighted(df, dict(dims.COMBINE_WEIGHT)).first().confidence == pytest.approx(want, abs=1e-6)


def test_fixed_and_advanced_ensembles(spark):
    make = lambda *rows: spark.createDataFrame([(1, "T1", n, c, False, 0) for n, c in rows], CANDIDATE)
    two, three = make(("rule_based", 0.6), ("bm25", 1.0)), make(("rule_based", 0.6), ("bm25", 1.0), ("kev", 0.9))
    assert fusion.fixed_ensemble(two).first().confidence == pytest.approx(0.42)
    assert fusion.fixed_ensemble(three).first().confidence == pytest.approx(0.82225)
    params = spark.createDataFrame(dims.ENSEMBLE, "extractor string, weight double, scale double, shift double")
    assert fusion.advanced_ensemble(make(("rule_based", 0.6)), params).first().confidence == pytest.approx(0.48)
    assert fusion.advanced_ensemble(two, params).first().confidence == pytest.approx(0.655286, abs=1e-6)
    more = two.unionByName(two.withColumn("technique_id", F.lit("T2"))).unionByName(two.withColumn("technique_id", F.lit("T3")))
    related = spark.createDataFrame([("T1", "T2"), ("T1", "T3")], "a string, b string")
    assert confidence(fusion.advanced_ensemble(more, params, related), "T1") == pytest.approx(0.720814, abs=1e-6)


def test_text_worked_values(spark):
    assert one(spark, tx.normalize_ws(F.col("t")), t="T1059.001") == "T1059. 001"
    assert one(spark, tx.expand_abbreviations(F.col("t"), dims.ABBREVIATION[:1]), t="cve-2021-44228") == "common vulnerabilities and exposures-2021-44228"
    assert one(spark, tx.normalize_cve(F.col("t")), t="see Cve 2021 44228 now") == "see CVE-2021-44228 now"
    assert one(spark, tx.clean_markdown(F.col("t")), t="![alt](u) [x](y)") == "!alt x"
    assert one(spark, tx.related_weaknesses(F.col("t")), t="::276::285::434::693::") == ["CWE-276", "CWE-434"]
    assert one(spark, tx.related_weaknesses(F.col("t"), True), t="::276::285::434::693::") == ["CWE-276", "CWE-285", "CWE-434", "CWE-693"]
    assert one(spark, tx.key_values(F.col("t")), t="a=1;b=2||c=3") == [{"a": "1", "b": "2"}, {"c": "3"}] and one(spark, tx.key_values(F.col("t")), t="a=1") == []
    assert one(spark, tx.taxonomy_attack_ids(F.col("t")), t="TAXONOMY NAME:ATTACK:ENTRY ID:1574.010:ENTRY NAME:x::::TAXONOMY NAME:WASC:ENTRY ID:3") == ["T1574.010"]
    assert [tuple(s) for s in one(spark, tx.parse_skills(F.col("t")), t="::SKILL:know:LEVEL:High::SKILL:other:LEVEL:::")] == [("know", "High")]
    assert [tuple(s) for s in one(spark, tx.parse_skills(F.col("t")), t="::basic:: ::more::")] == [("basic", "Unknown"), ("more", "Unknown")]
    assert [r.type for r in one(spark, tx.parse_related_patterns(F.col("t")), t="::NATURE:ChildOf:CAPEC ID:1::NATURE:Odd:CAPEC ID:2::")] == ["CHILD_OF", "RELATED_TO"]
    assert [(c.scopes, c.impact, c.note) for c in one(spark, tx.parse_consequences(F.col("t")), t="::SCOPE:Integrity:SCOPE:Access:TECHNICAL IMPACT:Modify Data:NOTE:n::")] == [(["Integrity", "Access"], "Modify Data", "n")]
    assert [(c.text, c.impact) for c in one(spark, tx.parse_consequences(F.col("t")), t="plain")] == [("plain", "Unknown")]
    assert [s.step for s in one(spark, tx.parse_execution_flow(F.col("t")), t="::STEP:1:PHASE:Explore:DESCRIPTION:d:TECHNIQUE:t::")] == ["1"]
    assert one(spark, tx.truncate(F.col("t"), 3), t="abcd") == "abc..." and one(spark, tx.percent(F.col("t")), t=0.125) == "12%"
    assert one(spark, tx.keyword_preview(F.array(*[F.lit(str(i)) for i in range(6)])), t=1) == "0, 1, 2, 3, 4..."
    assert one(spark, tx.content_type(F.col("t")), t="/a/b.HTM") == "html" and one(spark, tx.entity_type(F.col("t")), t="CAPEC-1") == "capec"


def test_segments_pack_sentences(spark):
    text = "Short one.\n\n  \n\n" + " ".join(f"Sentence number {i} is here!" for i in range(12)) + "\n\n" + "x" * 150 + ". End."
    got = one(spark, segments.paragraph_segments(F.col("t"), 100), t=text)
    assert got == segments.by_paragraph(text, 100)
    assert got[0] == "Short one." and all(len(s) < 100 for s in got[1:-3]) and got[-2:] == ["x" * 150 + ".", "End."]
    assert " ".join(s for s in got[1:] if s) == " ".join(text.split("\n\n")[2:])
    assert segments.by_paragraph(None) == [] and segments.by_line("") == [] and segments.by_line("a\n\n b \n" + "c. " * 10, 12) == ["a b", "c. c. c. c.", "c. c. c. c.", "c. c."]
    assert segments.page_text("<p>a&amp;b</p>\n<script>x</script> c  d <!-- no -->") == "a&b\nc\nd"


def test_chunks_end_at_boundaries(spark):
    text = ("word " * 50 + "end. ") * 200
    spans = segments.chunk_spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b[0] == a[1] - 500 for a, b in zip(spans, spans[1:]))
    assert all(text[e - 2 : e] == ". " for _, e in spans[:-2]) and segments.chunk_spans("short") == [(0, 5)] and segments.chunk_spans(None) == [(0, 0)]
    long = "x" * 30_000  # no boundary: chunks of full size
    assert segments.chunk_spans(long)[:2] == [(0, 5000), (4500, 9500)]


def test_matcher_takes_whole_words_of_any_alphabet(spark):
    docs = spark.createDataFrame([(1, "Naïve na na-na vers la ñana c++ C2c c2"), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.technique_id): (r.match_count, r.keywords) for r in scorers.rule_v1(docs, [("A", "na"), ("A", "na-na"), ("B", "c2")]).collect()}
    assert got == {"A": (2, ["na", "na-na"]), "B": (1, ["c2"])}  # the longest of those that begin together
    many = [(f"T{i % 800}", f"kw{i}") for i in range(10_000)]
    few = scorers.rule_v2(docs, many)
    assert len(few._jdf.queryExecution().optimizedPlan().toString()) < 5_000 and few.count() == 0


def test_zero_vectors_are_unlike(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert df.select(tx.cosine(F.col("embedding"), F.col("embedding"))).collect() == [(0.0,), (1.0,)]
    assert [r.score for r in scorers.vector_topk(df, df, 1).orderBy("query_id").collect()] == [0.0, 1.0]


def test_inverted_lists_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0")
    exact = {(r.query_id, r.vec_id) for r in scorers.vector_topk(q, e, 5, "l2").collect()}
    found = {(r.query_id, r.vec_id) for r in scorers.vector_lists(q, e, 5, lists=16, probes=12, block=20).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_feedback_folds_in_parts(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice(["correct", "incorrect", "unsure"]), rng.choice([None, "T1"])) for i in range(400)]
    want, n = {}, {}
    for e, _, kind, suggested in rows:
        if kind == "correct" or kind == "incorrect" and suggested:
            w = want.get(e, 1.0)
            want[e] = min(w * 1.05, 1.5) if kind == "correct" else max(w * 0.95, 0.5)
            n[e] = n.get(e, 0) + 1
    rng.shuffle(rows)
    got = fusion.feedback_weights(spark.createDataFrame(rows, "extractor string, seq int, kind string, suggested string").repartition(7))
    assert {r.extractor: (r.n, r.weight) for r in got.collect()} == {e: (n[e], pytest.approx(w, abs=1e-6)) for e, w in want.items()}


@pytest.mark.parametrize("jobs, workers, want", [(2, 10, 2), (100, 5, 6), (7, 2, 3), (8, 2, 3), (0, 0, 1), (5, 0, 1), (1, 3, 2), (9, 10, 5), (35, 10, 10)])
def test_autoscale(spark, jobs, workers, want):
    df = spark.createDataFrame([("q", jobs, workers)], "queue string, jobs long, workers long")
    assert windows.autoscale(df).first().target == want


def test_trend_counts_checks_with_issues(spark):
    rows = [("a", i, 5 if i < 3 else 0) for i in range(20)] + [("b", i, 1 if i > 15 else 0) for i in range(20)] + [("c", i, 9) for i in range(20)] + [("d", 1, 1)]
    got = {r.key: (r.recent, r.previous, r.trend) for r in quality.trend(spark.createDataFrame(rows, "key string, seq int, issues int")).collect()}
    assert got == {"a": (0, 3, "improving"), "b": (4, 0, "worsening"), "c": (10, 10, "stable"), "d": (1, 0, "insufficient_data")}


def test_classifier_learns(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    held = e.where("vec_id % 5 = 0")
    best = classifier.classify(classifier.train(e.where("vec_id % 5 <> 0")), held, threshold=0.0, k=1).join(held.select("vec_id", F.col("label").alias("truth")), "vec_id")
    n, labels = held.count(), e.select("label").distinct().count()
    assert best.count() == n and all(0 <= r.confidence <= 1 for r in best.collect())
    separable = spark.createDataFrame([(i, [float(i % 2), float(1 - i % 2)], i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
    model = classifier.train(separable)
    assert {(r.vec_id % 2, r.label) for r in classifier.classify(model, separable, 0.5, 1).collect()} == {(0, 0), (1, 1)} and labels > 1
    assert {(r.vec_id % 2, r.label) for r in classifier.by_similarity(separable, separable, 0.5, 1).collect()} == {(0, 0), (1, 1)}


def test_metric_families(spark, tmp_path):
    assert len(sinks.METRIC_FAMILIES) == 14
    rows = spark.createDataFrame([(7, "T1", 0.5, "x")], "job_id long, technique_id string, raw_score double, other string")
    sinks.write_metrics("bm25_scores", rows, str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/bm25_scores").first()
    assert (got.job_id, got.technique_id, got.raw_score, got.matched_terms) == ("7", "T1", 0.5, None)
    for family in sinks.METRIC_FAMILIES:
        assert sinks.metric_rows(family, rows).columns[:2] == ["id", "job_id"]


def test_chunks_cover_texts(spark):
    text = "abcdefghij" * 3000
    got = one(spark, tx.chunks(F.col("t")), t=text)
    assert "".join(c.text[: (5000 - 500) if i + 1 < len(got) else None] for i, c in enumerate(got)) == text


def test_snapshots_properties(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    assert snapshot.diff(a, a, "id").count() == 0
    assert sorted(snapshot.merge(a, spark.createDataFrame([(2, "y"), (3, "z")], a.schema), "id").collect()) == [(1, "x"), (2, "y"), (3, "z")]


def test_quality_worked_values(spark):
    ops = spark.createDataFrame([("e", "delete", 1, 1, 1), ("e", "update", 2, 3, 2)], "entity_id string, operation string, ts long, version int, seq long")
    assert quality.temporal_coherence(ops).count() == 2
    bare = spark.createDataFrame([("e", None, 1, 1, 1), ("", "update", 2, 1, 2), ("f", "update", None, 1, 3), ("f", "update", 4, 1, 4)], "entity_id string, operation string, ts long, version int, seq long")
    assert [(r.seq, r.issue) for r in quality.temporal_coherence(bare).orderBy("seq").collect()] == [(i, "missing fields") for i in (1, 2, 3)]
    assert [r.parent for r in quality.orphans(spark.createDataFrame([("T1059.001",), ("T1",)], "technique_id string")).collect()] == ["T1059"]
    assert quality.check_schema(spark.createDataFrame([(1, None, "x")], "k int, name string, d string"), ["k"], ["name", "d"]).first().issue == "missing name"


def test_ner_scores(spark):
    pairs = spark.createDataFrame([(f"e{i}", f"k{i}", "T1059") for i in range(12)], "entity string, keyword string, technique_id string")
    for n, want in ((1, 0.45), (9, 0.85), (12, 0.85)):
        mentions = spark.createDataFrame([(1, f"e{i}", "MALWARE") for i in range(n)], "doc_id long, entity string, entity_type string")
        assert scorers.ner_match(mentions, pairs).first().confidence == pytest.approx(want)
    affinity = spark.createDataFrame(dims.AFFINITY, "entity_type string, technique_id string")
    mentions = spark.createDataFrame([(1, "e0", "MALWARE"), (1, "e1", "MALWARE")], "doc_id long, entity string, entity_type string")
    assert scorers.ner_match(mentions, pairs, affinity).first().confidence == pytest.approx(0.66)


def test_sources(spark, tmp_path):
    ref = lambda i: [{"source_name": "mitre-attack", "external_id": i, "url": f"u/{i}"}]
    bundle = {"objects": [
        {"type": "x-mitre-tactic", "id": "t--1", "name": "Execution", "x_mitre_shortname": "execution", "external_references": ref("TA0002")},
        {"type": "attack-pattern", "id": "a--1", "name": "Scripting", "description": "d", "external_references": ref("T1059"), "kill_chain_phases": [{"kill_chain_name": "k", "phase_name": "execution"}], "x_mitre_platforms": ["Linux"]},
        {"type": "intrusion-set", "id": "g--1", "name": "G", "external_references": ref("G1")}, {"type": "relationship", "relationship_type": "uses", "source_ref": "g--1", "target_ref": "a--1"},
        {"type": "relationship", "relationship_type": "uses", "source_ref": "gone", "target_ref": "a--1"},
    ]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    objects = catalogs.stix_objects(spark, str(tmp_path / "b.json"))
    t = catalogs.stix_techniques(objects).first()
    assert (t.technique_id, t.tactics, t.tactic_refs) == ("T1059", ["Execution"], ["TA0002"])
    assert [tuple(r) for r in catalogs.stix_edges(objects).collect()] == [("G1", "USES", "T1059")]
    (tmp_path / "k.csv").write_text('cveID,vendorProject,product,dateAdded,knownRansomwareCampaignUse,cwes\n2021-1,v,p,1/5/2022,Known,"79, 89"\nCVE-2020-2,v,p,2020-01-02,Unknown,CWE-22\n')
    kev = {r.cve_id: r for r in catalogs.kev_catalogue(spark, str(tmp_path / "k.csv")).collect()}
    assert kev["CVE-2021-1"].cwes == ["CWE-79", "CWE-89"] and kev["CVE-2021-1"].date_added == "2022-01-05" and kev["CVE-2021-1"].known_ransomware and kev["CVE-2020-2"].cwes == ["CWE-22"]
    (tmp_path / "m.csv").write_text("capability_id,attack_object_id\nCVE-2021-1 x,T1059\nCVE-2021-1,T1059\n,T1\n")
    assert catalogs.cve_technique_map(spark, str(tmp_path / "m.csv")).count() == 1
    (tmp_path / "kw.json").write_text('{"T1": ["a", "b"], "T2": []}')
    assert catalogs.keyword_file(spark, str(tmp_path / "kw.json")).count() == 2
    (tmp_path / "c.csv").write_text("'ID,Name,Prerequisites,Related Weaknesses,Taxonomy Mappings\n1,N,::a::b::,::276::285::,TAXONOMY NAME:ATTACK:ENTRY ID:1574:ENTRY NAME:x\n1,N,,,\n")
    c = catalogs.pattern_catalogue(spark, str(tmp_path / "c.csv")).collect()
    assert len(c) == 1 and c[0].capec_id == "CAPEC-1" and c[0].weaknesses == ["CWE-276", "CWE-285"]  # the first row's
    assert {tuple(r) for r in catalogs.pattern_edges(catalogs.pattern_catalogue(spark, str(tmp_path / "c.csv"))).collect()} == {("CAPEC-1", "EXPLOITS", "CWE-276"), ("CAPEC-1", "EXPLOITS", "CWE-285"), ("CAPEC-1", "MAPPED_TO", "T1574")}
    assert {tuple(r) for r in catalogs.kev_edges(catalogs.kev_catalogue(spark, str(tmp_path / "k.csv"))).collect()} >= {("CVE-2020-2", "HAS_WEAKNESS", "CWE-22")}
    known = spark.createDataFrame([("CVE-2021-1", "T1059")], "cve_id string, technique_id string")
    assert catalogs.enables_edges(catalogs.cve_technique_map(spark, str(tmp_path / "m.csv")), known, known).first().type == "ENABLES"
    (tmp_path / "ab.csv").write_text("pos,abbreviation,expansion\n2,b,bee\n1,a,ay\n")
    assert catalogs.abbreviations(spark, str(tmp_path / "ab.csv")) == [("a", "ay"), ("b", "bee")]
    (tmp_path / "f.csv").write_text("id,published,description_en,cvss31_baseScore,weaknesses,configurations\nCVE-1-1,2020,d,,CWE-79,a=1||b=2\nX,,,,,\n")
    f = catalogs.cve_feed(spark, str(tmp_path / "f.csv")).collect()
    assert len(f) == 1 and f[0].cvss31 == 0.0 and f[0].cwes == ["CWE-79"] and len(f[0].configurations) == 2
    (tmp_path / "d.csv").write_text("def_tech,off_tech_id\nhttp://x#D3-A,http://x/T1059\n")
    assert tuple(catalogs.defence_edges(spark, str(tmp_path / "d.csv")).first()) == ("D3-A", "COUNTERS", "T1059")
    (tmp_path / "d2.csv").write_text("def_tech,def_tech_label,def_artifact,def_artifact_label,def_artifact_rel\nhttp://x#D3-A,A,http://x#File,File,http://x#analyzes\nhttp://x#D3-A,A,http://x#File,File,\n")
    assert {tuple(r) for r in catalogs.defence_nodes(spark, str(tmp_path / "d2.csv")).collect()} == {("D3-A", "defence", "A"), ("File", "artifact", "File")}
    assert {r.type for r in catalogs.artifact_edges(spark, str(tmp_path / "d2.csv")).collect()} == {"ANALYZES", "RELATES"}
    (tmp_path / "e.csv").write_text("eav_id,attack_id,version\nEAV1,T1,\n")
    assert catalogs.engagement_edges(spark, str(tmp_path / "e.csv")).first().version == 0
    (tmp_path / "p.html").write_text("<p>Hi <b>you</b></p><script>x</script>")
    assert catalogs.documents(spark, str(tmp_path / "p.html")).first().text == "Hi you"
    import hashlib

    assert catalogs.verify(spark, str(tmp_path / "e.csv"), hashlib.sha256((tmp_path / "e.csv").read_bytes()).hexdigest())


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    sinks.upsert(spark, f"{tmp_path}/nodes", a, "id", "v1")
    after = sinks.upsert(spark, f"{tmp_path}/nodes", spark.createDataFrame([(2, "z"), (3, "w")], a.schema), "id", "v2")
    assert sorted(after.collect()) == [(1, "x"), (2, "z"), (3, "w")]
    sinks.upsert(spark, f"{tmp_path}/nodes", spark.createDataFrame([(4, "q")], a.schema), "id", "v10")
    (tmp_path / "nodes" / "_temporary").mkdir()
    assert sinks.upsert(spark, f"{tmp_path}/nodes", spark.createDataFrame([(5, "r")], a.schema), "id", "v11").count() == 5
    nodes = spark.createDataFrame([("A",), ("B",)], "id string")
    edges = spark.createDataFrame([("A", "R", "B"), ("A", "R", "C")], "src string, type string, dst string")
    assert sinks.merge_edges(edges.limit(0), edges, nodes).count() == 1
    sinks.write_results(a.withColumn("created", F.lit("2024-01-02 03:00:00").cast("timestamp")), f"{tmp_path}/r")
    sinks.write_records(a, f"{tmp_path}/j")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2 and spark.read.json(f"{tmp_path}/j").count() == 2


def drained(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    got = drained(requests.rate_windows(stream, "1 hour", 2), "complete", "rate")
    want = windows.rate_window(e, 3600, 2)
    assert sorted((r.user_id, r.start.timestamp() // 3600, r.n, r.rejected) for r in got.withColumn("start", F.col("start")).collect()) == sorted((r.user_id, r.bucket, r.n, r.rejected) for r in want.collect())
    states = drained(requests.latest_states(stream), "update", "states")
    last = states.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), "n_events").alias("s"), F.max("n_events").alias("n")).collect()
    assert {r.user_id: (r.s.event_type, r.s.event_id, r.n) for r in last} == {r.user_id: (r.event_type, r.event_id, r.n_events) for r in relational.job_latest_state(spark, sf_dir).collect()}
    once = drained(requests.expire(stream.selectExpr("event_type AS key", "ts"), "400 days"), "append", "once")
    assert once.count() == e.select("event_type").distinct().count()


def test_vector_search_matches_brute_force(spark, sf_dir):
    import numpy as np

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.collect()
    m = np.array([r.embedding for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = scorers.vector_topk(e.where("vec_id % 50 = 0"), e, 3, query_block=4, base_block=100).collect()
    assert len(got) == 30
    for r in got:
        i, j = (next(k for k, x in enumerate(rows) if x.vec_id == v) for v in (r.query_id, r.vec_id))
        assert r.score == pytest.approx(m[i] @ m[j], abs=1e-4)


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 3.0), ("a", None), ("a", 500.0)], "k string, v double")
    got = {r.le: r.n for r in metrics.histogram(df, "v", [0.1, 5.0], ["k"]).collect()}
    assert got == {"0.1": 1, "5.0": 2, "+Inf": 3}


def test_entities_without_their_semicolon():
    page = "<p>a&amp</p> b&amp;&ampx; &lt;i&gt &copy &#38; &#38 c &amp;lt; d&"
    assert segments.page_text(page) == "a& b&&x; <i> © & & c &lt; d&"
    assert segments.page_text(page, closed=True) == "a&amp b&&ampx; <i&gt &copy & &#38 c &lt; d&"
    duckdb = pytest.importorskip("duckdb")
    from cairnwatch.plans import records

    page = "<h1>Rea&amp</h1><p>&lt;b&amp;&amp;&amp; c&amp"
    (want,) = duckdb.sql(f"SELECT array_to_string({records._PLAIN}, chr(10)) AS t FROM (SELECT '{page}' AS html)").fetchall()[0]
    assert segments.page_text(page, closed=True) == want


def test_batches_of_texts_are_small(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a scan").alias("text"))
    batch = F.pandas_udf(lambda s: s.map(lambda _: len(s)), "long")
    spark.conf.unset(name)
    for start in (lambda: scoring.docs_of(spark, "/root/testdata/sf0.001"), lambda: scorers.rule_v2(docs, [("T1", "scan")]), lambda: scorers.query_terms(docs, docs.select(F.lit("scan").alias("term")))):
        start()
        assert docs.select(F.max(batch("text"))).first()[0] <= 500
        spark.conf.set(name, "100")
        start()
        assert spark.conf.get(name) == "100"
        spark.conf.unset(name)


def _widths(df):
    """Partitions of the exchanges that a plan names a number for."""
    return [int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())]


def test_names_meet_by_pairs_of_words(spark):
    names = [(f"n{i}", f"pattern a{i // 3} b{i // 5}, x") for i in range(60)]
    left = spark.createDataFrame([*names, ("n0", "x"), ("e", ""), ("z", None)], "id string, name string")
    right = spark.createDataFrame([(f"m{i}", f"a{i // 2} of B{i // 5} x") for i in range(60)], "id string, name string")
    words = lambda rows: {r.id: set(re.findall("[a-z0-9]+", (r["name"] or "").lower())) for r in rows if r["name"]}
    ours, theirs = words(spark.createDataFrame(names, "id string, name string").collect()), words(right.collect())
    want = {(a, b): len(x & y) for a, x in ours.items() for b, y in theirs.items() if len(x & y) >= 2}
    assert {(r.a, r.b): r.n_common for r in graph.name_similarity(left, right).collect()} == want
    assert {(r.a, r.b) for r in graph.name_similarity(left, right, 3).collect()} == {k for k, n in want.items() if n >= 3}


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scoring, "DEALT_ROWS", 100)
    monkeypatch.setattr(graph, "TASK_NAMES", 50)
    sf = "/root/testdata/sf0.001"
    most = lambda df: max(_widths(df), default=0)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert most(scoring.QUERIES["advanced_ensemble"](spark, sf)) == most(scoring.QUERIES["ensemble_related_boost"](spark, sf)) == most(relational.QUERIES["top_techniques"](spark, sf)) == -(-rows // 100)
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    assert most(relational.QUERIES["capec_name_similarity"](spark, sf)) == -(-2 * parts // 50)
    monkeypatch.setattr(patterns, "STEP_ROWS", 100)
    steps = spark.range(1000).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("R").alias("type"), F.lit("b").alias("dst"))
    assert most(patterns.match(steps.select(F.col("src").alias("id"), F.lit("a").alias("label")), steps, Pattern("s", None, (Hop(("R",), name="e"),)))) == 10
    monkeypatch.setattr(graph, "TASK_EDGES", 100)
    assert most(graph.build_edges(steps, steps.select(F.col("src").alias("id")))) == 10
