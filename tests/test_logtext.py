"""Stack lines as log collectors tell them."""

from opsweave.functions.logtext import is_stack_line
from opsweave.operators import logs
from pyspark.sql import functions as F

LINES = {
    "    at com.acme.Main.run(Main.java:10)": True,
    '  File "app.py", line 3, in f': True,
    "Traceback (most recent call last):": True,
    "goroutine 1 [running]:": True,
    "\tat x": True,
    "  main.go:12 +0x1d": True,
    "   return compute()": True,
    "   short()": False,
    "   nothing to be seen here": False,
    "at the start": True,
    "main.handler(0x1)": False,
    "      ^": False,
    "plain text with app.py: in it": False,
    "": False,
}


def test_stack_lines(spark):
    rows = spark.createDataFrame([(k,) for k in LINES], "line string").select("line", is_stack_line(F.col("line")).alias("is")).collect()
    assert {r.line: r["is"] for r in rows} == LINES


def test_folding_strips_lines(spark):
    text = ["ERROR boom", "   at a.B.c(B.java:1)", "  other.go:12 something", "goroutine 7 [running]", "INFO fine"]
    frame = spark.createDataFrame([("p", "c", i, t) for i, t in enumerate(text)], "pod string, container string, line_no long, line string")
    found = {r.line: r.stack.split("\n") for r in logs.fold_entries(logs.parse_lines(frame)).collect() if r.n_stack}
    assert found == {"ERROR boom": [text[1]], text[2]: [text[3]]}
