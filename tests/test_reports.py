"""Units, recommendations, reports, cache keys and reranking on rows made by hand."""

import hashlib
import random

import __spark_entry__ as E
from pyspark.sql import functions as F

from opsweave.functions import quantity as Q, text as X
from opsweave.operators import forecast, inspection as I, retrieval as R


def test_units(spark):
    rows = [
        ("length", "M", "ft", 2.0, 6.56168), ("length", "ft", "m", 10.0, 3.048), ("length", "km", "m", 1.0, None), ("weight", "lb", "oz", 3.0, 48.0), ("weight", "oz", "lb", 3.0, None),
        ("storage", "kb", "B", 1.5, 1536.0), ("storage", "tb", "gb", 1.0, None), ("time", "h", "day", 12.0, 0.5), ("time", "min", "h", 90.0, 1.5), ("temperature", "f", "c", 212.0, 100.0),
        ("temperature", "k", "f", 273.15, 32.0), ("temperature", "c", "k", 1.0, 274.15), ("length", "m", "kg", 1.0, None), ("mood", "m", "cm", 1.0, None), (None, None, None, 1.0, None), ("length", "m", "cm", None, None),
    ]
    df = spark.createDataFrame(rows, "kind string, source string, target string, v double, want double")
    got = Q.convert_rows(df, "v", "kind", "source", "target").collect()
    assert len(got) == len(rows) and all(r.converted == r.want for r in got)


def test_recommendations(spark):
    schema = "seq long, severity string, recommendation string"
    rows = [(3, "low", "b"), (1, "high", "a"), (2, "low", "b"), (4, None, None), (5, "low", "c")]
    said = [r.recommendation for r in I.collected_recommendations(spark.createDataFrame(rows, schema)).orderBy("place").collect()]
    assert said == ["a", "b", "c", *I.GENERAL]
    calm = spark.createDataFrame([r for r in rows if r[1] != "high"], schema)
    assert [r.recommendation for r in I.collected_recommendations(calm).orderBy("place").collect()] == ["b", "c"]
    many = spark.createDataFrame([(i, "high", f"r{i:02}") for i in range(20)], schema)
    assert [r.recommendation for r in I.collected_recommendations(many).orderBy("place").collect()] == [f"r{i:02}" for i in range(10)]
    assert I.collected_recommendations(spark.createDataFrame([], schema)).count() == 0


def lines(df):
    return [r.line for r in df.orderBy("section", "n", "part").collect()]


def test_report(spark):
    schema = "rule_id string, severity string, resource string, message string, score double"
    rows = [("r2", "low", "n/x", "m"), ("r1", "high", "", None), ("r1", None, None, "")] + [("r3", "medium", f"n/{i % 3}", "same") for i in range(40)]
    findings = spark.createDataFrame([(*r, 1.0) for r in rows], schema)
    advice = I.collected_recommendations(spark.createDataFrame([(1, "high", "do")], "seq long, severity string, recommendation string"))
    got = lines(I.report_rows(findings, advice, "7", "cluster", "ns", 4))
    assert got[:6] == ["# 巡检报告 7", "", "## 概览", "- 范围: cluster ns", "- 检查数: 4，问题: 43 (H/M/L: 1/40/1)", ""]
    assert got[6:12] == ["## 发现列表", "1. [LOW] r1", "2. [HIGH] r1", "3. [LOW] r2", "   - 资源: n:x", "   - 描述: m"]
    heads = [x for x in got if x[0].isdigit()] if all(got) else [x for x in got if x and x[0].isdigit()]
    assert [int(x.split(".")[0]) for x in heads] == list(range(1, 44))
    assert got[-10:] == ["", "## 建议", "- do", *["- " + g for g in I.GENERAL], "", "## 统计", "- r1: 2", "- r2: 1", "- r3: 40"]
    none = I.report_rows(findings.where("false"), advice.where("false"), "8", "cluster")
    assert lines(none) == ["# 巡检报告 8", "", "## 概览", "- 范围: cluster ", "- 检查数: 9，问题: 0 (H/M/L: 0/0/0)", "", "## 发现列表", "无显著问题", "", "## 建议", "- 暂无", "", "## 统计"]


def test_cache_key(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("What is the Pod-state, pod?", None), ("Pod", "Answer: restart_it now!"), ("", "a of"), ("x y", "  ")]
    df = spark.createDataFrame(rows, "q string, before string")
    got = [r.k for r in df.select(X.cache_key(F.col("q"), before=F.col("before")).alias("k")).collect()]
    assert got == [sha("pod|state"), sha("pod|ctx:Answer:|now!|restart_it"), sha("|ctx:of"), sha("")]


def test_rerank(spark):
    rows = [(1, 1, 0.5, "a b", "B c " * 60), (1, 2, 0.1, "a b", None), (1, 3, None, "a b", " ".join(["z"] * 100 + ["a"])), (2, 1, 0.9, None, "a"), (1, 4, 0.5, "a b", "b")]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, score double, query string, text string")
    got = {(r.query_id, r.rank): (r.doc_id, round(r.reranked, 9)) for r in R.best_reranked(df).collect()}
    assert got == {(1, 1): (1, 0.5), (1, 2): (4, 0.5), (1, 3): (3, 0.3), (2, 1): (1, 0.54)}


def test_diverse_choice_is_the_greedy_one(spark, data_dir):
    from opsweave.plans import retrieval_queries as Q

    def words(text):
        return set((text or "").lower().split()[:50])

    taken = {}
    for r in Q._reranked(spark, data_dir).orderBy("query_id", "rank").collect():
        kept = taken.setdefault(r.query_id, [])
        mine = words(r.text)
        if len(kept) < 5 and not any(mine and w and len(mine & w) / len(mine | w) > 0.7 for _, w in kept):
            kept.append((r.doc_id, mine))
    got = {}
    for r in E.queries()["reranked_diverse"](spark, data_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: [d for d, _ in kept] for q, kept in taken.items() if kept}


def test_listings_from_files(spark, tmp_path):
    from opsweave.operators import listings as L
    from opsweave.sources import tables as T

    def read(text, schema):
        (tmp_path / "x.json").write_text(text)
        return T.read_inventory(spark, str(tmp_path / "x.json"), schema)

    meta = '"metadata":{"name":"a","namespace":"n","labels":{"app":"web"},"annotations":%s}'
    sets = "{%s}\n{%s,\"spec\":{\"replicas\":2}}\n{%s}\n" % (meta % "null", meta % '{"deployment.kubernetes.io/revision":"10"}', meta % '{"deployment.kubernetes.io/revision":"x"}')
    got = L.rollout_history(read(sets, L.REPLICA_SETS)).collect()
    assert [(r.deployment, r.revision, r.change_cause, r.replicas, r.ready) for r in got] == [("web", 10, L.NO_CAUSE, 2, 0)]
    quota = "{%s,\"spec\":{\"hard\":{\"pods\":\"4\"}},\"status\":{\"used\":{\"cpu\":\"1\"}}}\n{%s}\n" % (meta % "{}", meta % "{}")
    maps = L.quotas(read(quota, L.QUOTAS))
    assert sorted((r.hard.get("pods", ""), r.used.get("cpu", ""), r.scopes) for r in maps.collect()) == [("", "", []), ("4", "1", [])]
    assert sorted((r.resource, r.hard, r.used) for r in L.quota_rows(maps).collect()) == [("cpu", None, "1"), ("pods", "4", None)]
    scaler = '{%s,"spec":{"scale_target_ref":{"kind":"Deployment","name":"web"},"max_replicas":3}}' % (meta % "{}")
    assert L.autoscalers(read(scaler, L.AUTOSCALERS)).first() == ("n", "a", "Deployment/web", None, 3, None, None)


def test_numbers_in_reasons_are_rounded_by_their_exact_value(spark):
    rng = random.Random(9)
    values = [704.25, 612.65, 18.15, 0.05, 0.25, 0.5, 1.5, 2.5, 99.95, 99.5, 0.0, 1e-9, 0.15, 0.35, 4503599627370497.5, -0.25, -2.675, 100000.0]
    values += [rng.randrange(10**7) / 100 for _ in range(2000)] + [rng.randrange(10**6) / 64 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select("v", *[forecast.fixed(F.col("v"), n).alias(f"f{n}") for n in (0, 1)])
    for r in df.collect():
        if r.v is None or abs(r.v) < 1e15:
            assert (r.f0, r.f1) == ((None, None) if r.v is None else (f"{r.v:.0f}", f"{r.v:.1f}"))
