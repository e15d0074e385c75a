"""What a plan reads: scans, pushed filters and the operators above them."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame


def explain(df: DataFrame) -> dict[str, Any]:
    """Scan formats, read columns, pushed filters, shuffles, joins and residual filters of a plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"^\(\d+\) ([A-Za-z]+)", text, re.M)
    lists = lambda key: [x.strip() for x in re.findall(rf"^{key}: \[(.*)\]$", text, re.M)]
    return {
        "scans": re.findall(r"^\(\d+\) Scan (\w+)", text, re.M),
        "pushed": lists("PushedFilters"),
        "read": re.findall(r"^ReadSchema: struct<(.*)>$", text, re.M),
        "exchanges": nodes.count("Exchange"),
        "joins": [n for n in nodes if n.endswith("Join")],
        "residual": re.findall(r"^Condition : (.*)$", text, re.M),
        "text": text,
    }
