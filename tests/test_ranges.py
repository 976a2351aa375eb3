"""The range source against a service that answers from the test tables, and stored pages."""

import collections
import datetime
import http.server
import json
import re
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from opsweave.operators import series
from opsweave.sources import ranges as R, tables as T

UTC = datetime.timezone.utc
DAY = int(datetime.datetime(2024, 1, 3, tzinfo=UTC).timestamp())


@pytest.fixture(scope="module")
def service(spark, data_dir):
    """Answers with each pod's mean of the step's minute, where it has one; ``asked`` keeps the requests."""
    rows = series.resample(T.samples(spark, data_dir).withColumn("pod", F.element_at("labels", "pod")), "1 minute", by=["metric", "pod"]).collect()
    held = collections.defaultdict(dict)
    for r in rows:
        held[r.metric, r.pod][int(r.ts.replace(tzinfo=UTC).timestamp())] = r.value
    asked = []

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            asked.append(q)
            if q["query"] == "broken":
                body = {"status": "error", "error": "no such function"}
            else:
                name = re.fullmatch(r'\{__name__=(~?)"(.+)"\}', q["query"])
                start, end, step = int(q["start"]), int(q["end"]), int(q["step"])
                found = []
                for (metric, pod), at in held.items():
                    if name[2] == metric or name[1]:
                        values = [[t, repr(at[t]) if t % 7200 else "none"] for t in range(start, end + 1, step) if t in at]
                        found.append({"metric": {"__name__": metric, "pod": pod}, "values": values})
                body = {"status": "success", "data": {"result": found}}
            data = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", held, asked
    server.shutdown()


def wanted(held, low, high, metrics=None):
    return sorted((m, p, t, v if t % 7200 else 0.0) for (m, p), at in held.items() for t, v in at.items() if low <= t <= high and (metrics is None or m in metrics))


def got(df):
    return sorted((r.metric, r.labels["pod"], r.t, r.value) for r in df.withColumn("t", F.unix_seconds("ts")).collect())


def test_slices_give_every_step_once(spark, service):
    url, held, asked = service
    asked.clear()
    rows = R.read_range(spark, url, DAY - 30, DAY + 6 * 86400, points=1000)
    assert got(rows) == wanted(held, DAY, DAY + 6 * 86400)
    assert len(asked) == 9 and {int(q["start"]) % 60 for q in asked} == {0}


def test_filters_are_pushed_into_requests(spark, service, capsys):
    url, held, asked = service
    low, high = (datetime.datetime.fromtimestamp(DAY + s, UTC) for s in (3600, 86400))
    rows = R.read_range(spark, url, DAY, DAY + 20 * 86400).where(F.col("metric").isin("click", "error") & (F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "In(metric, [click,error]), GreaterThanOrEqual(ts" in plan and ") Filter" not in plan, plan
    asked.clear()
    assert got(rows) == wanted(held, DAY + 3600, DAY + 86399, ("click", "error"))
    assert {q["query"] for q in asked} == {'{__name__="click"}', '{__name__="error"}'}
    assert {(int(q["start"]), int(q["end"])) for q in asked} == {(DAY + 3600, DAY + 86340)}
    # A filter that no request can say stays with Spark; one that leaves no time asks nothing.
    asked.clear()
    kept = R.read_range(spark, url, DAY, DAY + 86400).where("metric like 'c%' and value > 50")
    assert got(kept) == [r for r in wanted(held, DAY, DAY + 86400) if r[0].startswith("c") and r[3] > 50]
    asked.clear()
    assert R.read_range(spark, url, DAY, DAY + 86400).where(F.col("ts") < F.lit(datetime.datetime(2020, 1, 1, tzinfo=UTC))).count() == 0 and not asked


def test_a_failing_service_fails_the_query(spark, service):
    with pytest.raises(Exception, match="no such function"):
        R.read_range(spark, service[0], DAY, DAY + 60, query="broken").collect()
    with pytest.raises(Exception, match="needs the options"):
        spark.read.format("metric_range").load().collect()


def test_pages(spark, data_dir, tmp_path):
    path = str(tmp_path / "pages")
    samples = T.samples(spark, data_dir)
    R.write_pages(samples, path)
    start, end = datetime.datetime(2024, 1, 3, 12), datetime.datetime(2024, 1, 6)
    inside = (F.col("ts") >= F.lit("2024-01-03 12:00:00")) & (F.col("ts") < F.lit("2024-01-06 00:00:00"))
    rows = R.read_pages(spark, path, start, end, ["click", "view"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*page", plan) and re.search(r"PushedFilters: \[[^\]]*(In\(metric|metric)", plan)
    assert len({f.split("page=")[1].split("/")[0] for f in rows.inputFiles()}) >= 3
    flat = lambda df: sorted(map(str, df.select("metric", "ts", "value", F.element_at("labels", "pod")).collect()))
    assert flat(rows) == flat(samples.where(inside & F.col("metric").isin("click", "view")))
    # Writing one page again changes no other.
    again = samples.where(F.to_date("ts") == F.lit("2024-01-04"))
    R.write_pages(again, path)
    assert flat(R.read_pages(spark, path)) == flat(samples)


def test_pages_without_time(spark, tmp_path):
    path = str(tmp_path / "none")
    R.write_pages(spark.createDataFrame([("a", {"pod": "x"}, None, 1.0), (None, None, datetime.datetime(2024, 1, 1), None)], R.SAMPLES), path)
    assert R.read_pages(spark, path).count() == 2
    assert R.read_pages(spark, path, datetime.datetime(2023, 1, 1)).count() == 1
