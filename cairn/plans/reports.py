"""Reports of a run's tables: what was found and why it was chosen, in Markdown, as a notebook, and as a PDF of text.

Sentences are made from the written tables; a table that isn't there is left out. Whatever comes to the driver has a
bound: single rows, a few leading rows, or the first ``SHOWN`` rows of a table that a reader looks at.
"""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from cairn.functions.text import markdown, silhouette_class
from cairn.operators import views
from cairn.sources.tables import exists

#: Rows of a table in a report.
SHOWN = 30
SECTIONS = ("validation", "decisions", "profile", "hopkins", "scoreboard", "consensus_search", "consensus_vs_best_base", "composition", "labels", "drift", "drift_summary")
#: Lines of a PDF page, and characters of a line.
PAGE_LINES, PAGE_WIDTH = 66, 92

LIMITS = (
    "Internal measures rank partitions; they don't say what the clusters mean.",
    "The label takes no part in any fit. Its shares by cluster describe clusters, they don't validate them.",
    "Drift compares the train and test split of one table; it says nothing of later data.",
)


def ordered(name: str, table: DataFrame) -> DataFrame:
    """A section's table with its leading rows first."""
    if name in ("scoreboard", "consensus_search"):
        return table.orderBy("final_order")
    if name == "drift":
        return views.drift_order(table).orderBy("position").drop("position")
    if name in ("composition", "labels"):
        return table.orderBy("cluster")
    return table


def _of(n: int, one: str, many: str | None = None) -> str:
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def _decisions(t: DataFrame) -> Iterator[str]:
    r = t.first()
    yield f"Of {_of(r['n_input'], 'row')}, {r['n_output']:,} are kept."
    why = {"n_null": "lack a value", "n_negative_amount": "have a negative amount", "n_negative_time": "have a negative time", "n_bad_label": "have a label outside the domain", "n_duplicates": "repeat another row"}
    if told := [f"{r[c]:,} {text}" for c, text in why.items() if r[c]]:
        yield "Of the others, " + ", ".join(told) + " (a row may break several rules)."


def _validation(t: DataFrame) -> Iterator[str]:
    broken = t.where("violations > 0").groupBy("severity").agg(F.count("*").alias("n"), F.sum("violations").alias("rows")).orderBy("severity").collect()  # a row for each severity
    yield "; ".join(f"{_of(r['n'], 'check')} of severity {r['severity']} failed, on {_of(r['rows'], 'row or column', 'rows or columns')}" for r in broken) + "." if broken else "Every check of the raw table passed."


def _hopkins(t: DataFrame) -> Iterator[str]:
    r = t.agg(F.avg("hopkins").alias("m"), F.min("hopkins").alias("low"), F.max("hopkins").alias("high"), F.count("*").alias("n")).first()
    if r["m"] is not None:
        verdict = "clusters are likely" if r["m"] > 0.75 else "clusters are possible" if r["m"] > 0.5 else "rows look evenly spread"
        yield f"Hopkins statistic over {_of(r['n'], 'repetition')}: mean {r['m']:.3f} ({r['low']:.3f} to {r['high']:.3f}), so {verdict}."


def _leader(t: DataFrame, what: str) -> Iterator[str]:
    top = t.where("final_order <= 2").withColumn("structure", silhouette_class(F.col("silhouette"))).orderBy("final_order").collect()
    n = t.count()
    if top:
        first = top[0]
        yield f"{what} {first['run_id']} ranks first of {n:,}, with a sum of ranks of {first['rank_score']} (silhouette {first['silhouette']:.3f}, Davies-Bouldin {first['davies_bouldin']:.3f}, Calinski-Harabasz {first['calinski_harabasz']:.1f}); by its silhouette the structure is: {first['structure']}."
    if len(top) == 2:
        apart = top[1]["rank_score"] - top[0]["rank_score"]
        yield f"The runner-up, {top[1]['run_id']}, has the same sum of ranks; the silhouette decided." if apart == 0 else f"The runner-up, {top[1]['run_id']}, is {_of(apart, 'rank')} behind."


def _consensus(t: DataFrame) -> Iterator[str]:
    rows: dict[bool, Row] = {r["algorithm"] == "Consensus": r for r in t.limit(2).collect()}
    if len(rows) < 2:
        return
    own, base = rows[True], rows[False]
    known = [(m, more) for m, more in (("silhouette", True), ("davies_bouldin", False), ("calinski_harabasz", True)) if own[m] is not None and base[m] is not None]
    better = [m.replace("_", "-") for m, more in known if (own[m] > base[m] if more else own[m] < base[m])]
    yield f"Against the best base clustering the consensus is better in {len(better)} of {len(known)} internal measures" + (f" ({', '.join(better)})." if better else ".")


def _composition(t: DataFrame) -> Iterator[str]:
    r = t.where("lift is not null").orderBy(F.desc("lift"), "cluster").first()
    if r is not None:
        yield f"The label is most frequent in cluster {r['cluster']}: {r['positives']:,} of {_of(r['size'], 'row')}, {r['lift']:.2f} times its share of all rows."


def _drift(t: DataFrame) -> Iterator[str]:
    told = {r["status"]: r["n"] for r in t.groupBy("status").agg(F.count("*").alias("n")).collect()}  # three states
    yield "Features by state: " + ", ".join(f"{n} {s}" for s, n in sorted(told.items())) + "."
    top = t.where("psi is not null").orderBy(F.desc("psi"), "feature").first()
    if top is not None:
        yield f"{top['feature']} moved most, with a stability index of {top['psi']:.4f} and a largest distance of the distributions of {top['ks_statistic']:.4f}."
    if told.get("refit"):
        yield "Refit before the registry assigns more rows of the later kind."


TELLERS = {
    "validation": _validation,
    "decisions": _decisions,
    "hopkins": _hopkins,
    "scoreboard": lambda t: _leader(t, "Partition"),
    "consensus_search": lambda t: _leader(t, "The cut into this many clusters:"),
    "consensus_vs_best_base": _consensus,
    "composition": _composition,
    "drift": _drift,
}


def findings(spark: SparkSession, out: str) -> dict[str, list[str]]:
    """What each table that is there says, by section, in the order of ``SECTIONS``."""
    there = [s for s in SECTIONS if exists(spark, f"{out}/{s}")]
    return {s: list(TELLERS[s](spark.read.parquet(f"{out}/{s}"))) if s in TELLERS else [] for s in there}


def report(spark: SparkSession, out: str) -> str:
    """The Markdown report: a summary of all findings, each section's findings and table, and the limits."""
    told = findings(spark, out)
    parts = ["# Segmentation report"]
    if any(told.values()):
        parts += ["## summary", "\n".join(f"- {said}" for lines in told.values() for said in lines[:1])]
    for name, lines in told.items():
        parts += [f"## {name.replace('_', ' ')}", *([" ".join(lines)] if lines else []), markdown(ordered(name, spark.read.parquet(f"{out}/{name}")), SHOWN)]
    parts += ["## limits", "\n".join(f"- {x}" for x in LIMITS)]
    return "\n\n".join(parts) + "\n"


def notebook(spark: SparkSession, out: str) -> str:
    """A notebook (format 4) with the findings as text cells and, after each, a code cell that reads its table."""

    def cell(kind: str, source: str) -> dict:
        own = {"cell_type": kind, "metadata": {}, "source": source.splitlines(keepends=True)}
        return own | ({"execution_count": None, "outputs": []} if kind == "code" else {})

    cells = [cell("markdown", "# Segmentation report"), cell("code", "from cairn.runtime import build_session\n\nspark = build_session()\n" + f"out = {out!r}")]
    for name, lines in findings(spark, out).items():
        cells += [cell("markdown", "\n\n".join([f"## {name.replace('_', ' ')}", *lines])), cell("code", f'spark.read.parquet(f"{{out}}/{name}").show({SHOWN}, truncate=False)')]
    cells.append(cell("markdown", "## limits\n\n" + "\n".join(f"- {x}" for x in LIMITS)))
    return json.dumps({"cells": cells, "metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 4}, indent=1)


def pdf(text: str) -> bytes:
    """A text as a PDF of A4 pages in a fixed-width font; characters outside Latin-1 become question marks."""
    lines = [part for line in text.splitlines() for part in (textwrap.wrap(line, PAGE_WIDTH, replace_whitespace=False, drop_whitespace=False) or [""])]
    pages = [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)] or [[]]
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for i, page in enumerate(pages):
        shown = [line.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)").encode("latin-1", "replace") for line in page]
        stream = b"BT /F1 9 Tf 11.5 TL 48 800 Td " + b" ".join(b"(" + s + b") Tj T*" for s in shown) + b" ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%b\nendstream" % (len(stream), stream))
    made, at = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        at.append(len(made))
        made += b"%d 0 obj\n%b\nendobj\n" % (n, body)
    table = len(made)
    made += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(made + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))
