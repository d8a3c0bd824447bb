"""A run's results as one HTML page that needs nothing beside it, and the assignment of single records.

The page shows bounded views only (``cairn.operators.views``): single rows, a row for each cluster or feature, and
``SHOWN`` points. A table that isn't there is left out. Colours follow the clusters, in a fixed order.
"""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.operators import views
from cairn.plans import flows, reports
from cairn.sources.tables import RAW_COLUMNS, exists

#: Colours of the first clusters on light and dark ground; further clusters share a grey. Fixed values.
LIGHT = ("#2a78d6", "#eb6834", "#1baf7a", "#eda100", "#e87ba4", "#008300", "#4a3aa7", "#e34948")
DARK = ("#3987e5", "#d95926", "#199e70", "#c98500", "#d55181", "#008300", "#9085e9", "#e66767")
#: Rows of a table on the page.
ROWS = 60


def _colours(values: tuple[str, ...]) -> str:
    return "".join(f"--c{i}:{v};" for i, v in enumerate(values)) + "--c8:#898781;"


STYLE = f"""
:root{{color-scheme:light dark;--ground:#fcfcfb;--ink:#0b0b0b;--soft:#52514e;--line:#dddcd8;{_colours(LIGHT)}}}
@media (prefers-color-scheme:dark){{:root{{--ground:#1a1a19;--ink:#fff;--soft:#c3c2b7;--line:#3c3c3a;{_colours(DARK)}}}}}
body{{font:15px/1.5 system-ui,sans-serif;color:var(--ink);background:var(--ground);max-width:70rem;margin:2rem auto;padding:0 1rem}}
.tiles{{display:flex;flex-wrap:wrap;gap:2.5rem}}.tiles b{{display:block;font-size:1.9rem;line-height:1.2}}.tiles span,caption,th,figcaption{{color:var(--soft)}}
table{{border-collapse:collapse;font-size:.85rem;display:block;overflow-x:auto}}th,td{{text-align:left;padding:.2rem .7rem .2rem 0;border-bottom:1px solid var(--line);white-space:nowrap}}
.bar{{display:inline-block;height:.7rem;border-radius:0 4px 4px 0;margin-right:.5rem;vertical-align:middle}}
svg{{width:100%;height:auto;border:1px solid var(--line)}}circle{{stroke:var(--ground);stroke-width:1}}label{{margin-right:1rem}}.key{{display:inline-block;width:.8rem;height:.8rem;border-radius:50%;margin:0 .3rem}}
"""
SCRIPT = "document.querySelectorAll('[data-toggle]').forEach(b=>b.addEventListener('change',()=>document.querySelectorAll('.'+b.dataset.toggle).forEach(c=>c.style.display=b.checked?'':'none')));"


def _text(value) -> str:
    return html.escape("" if value is None else f"{value:,.4f}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value))


def table(df: DataFrame, rows: int = ROWS) -> str:
    """The first rows of a small frame as an HTML table."""
    body = "".join("<tr>" + "".join(f"<td>{_text(v)}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
    return "<table><thead><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + f"</tr></thead><tbody>{body}</tbody></table>"


def bars(items: list[tuple[str, float, int]], title: str) -> str:
    """A list of (name, value, colour's number) with a bar for each value's size; the value stands beside it."""
    most = max((abs(v) for _, v, _ in items), default=0.0) or 1.0
    rows = "".join(f'<tr><td>{html.escape(n)}</td><td title="{html.escape(n)}: {v:,.4f}"><span class="bar" style="width:{18 * abs(v) / most:.2f}rem;background:var(--c{min(c, 8)})"></span>{_text(v)}</td></tr>' for n, v, c in items)
    return f"<table><caption>{html.escape(title)}</caption><tbody>{rows}</tbody></table>"


def scatter(points: list, title: str) -> str:
    """Points (id, cluster, x, y, ...) in the plane of the first two components, with a switch for each cluster."""
    own = [p for p in points if p["x"] is not None and p["y"] is not None]
    if not own:
        return ""
    low = {a: min(p[a] for p in own) for a in "xy"}
    wide = {a: max(p[a] for p in own) - low[a] or 1.0 for a in "xy"}
    number = {c: i for i, c in enumerate(sorted({p["cluster"] for p in own}))}

    def mark(p) -> str:
        told = ", ".join(f"{k} {_text(v)}" for k, v in p.asDict().items())
        return f'<circle class="k{number[p["cluster"]]}" cx="{12 + 776 * (p["x"] - low["x"]) / wide["x"]:.1f}" cy="{468 - 456 * (p["y"] - low["y"]) / wide["y"]:.1f}" r="4" fill="var(--c{min(number[p["cluster"]], 8)})" fill-opacity=".7"><title>{told}</title></circle>'

    switches = "".join(f'<label><input type="checkbox" checked data-toggle="k{i}"><span class="key" style="background:var(--c{min(i, 8)})"></span>cluster {_text(c)}</label>' for c, i in number.items())
    return f'<p>{switches}</p><figure><svg viewBox="0 0 800 480" role="img" aria-label="{html.escape(title)}">{"".join(map(mark, own))}</svg><figcaption>{html.escape(title)}</figcaption></figure>'


def page(spark: SparkSession, out: str, clusters: list[int] | None = None, shown: int = views.SHOWN) -> str:
    """The dashboard of a run below ``out``: overview, explorer (of the chosen clusters), evaluation and drift."""
    there = lambda *names: all(exists(spark, f"{out}/{n}") for n in names)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    parts = ["<h1>Segmentation</h1>"]
    if there("clean", "consensus", "x_pca"):
        one = views.overview(read("clean"), read("consensus"), read("x_pca")).first()
        parts.append('<div class="tiles">' + "".join(f"<div><b>{_text(v)}</b><span>{k}</span></div>" for k, v in one.asDict().items()) + "</div>")
    if told := reports.findings(spark, out):
        parts.append("<ul>" + "".join(f"<li>{html.escape(said)}</li>" for lines in told.values() for said in lines) + "</ul>")
    if there("consensus"):
        sized = views.sizes(read("consensus")).orderBy("cluster").collect()  # a row for each cluster
        parts += ["<h2>Clusters</h2>", bars([(f"cluster {r['cluster']}", float(r["size"]), i) for i, r in enumerate(sized)], "rows of the sample")]
    if there("labels"):
        parts.append(table(read("labels").orderBy("cluster")))
    if there("composition"):
        parts.append(table(read("composition").orderBy("cluster")))
    if there("consensus", "x_pca", "metadata"):
        facts = read("metadata").select(F.col("row_id").alias("id"), "Time", "Amount", "Class")
        drawn = views.points(read("x_pca"), read("consensus"), facts, clusters, shown).orderBy("id").collect()  # ``shown`` rows at most
        parts += ["<h2>Explorer</h2>", scatter(drawn, f"First two components of {len(drawn):,} rows")]
    if there("profiles"):
        far = views.deviations(read("profiles"))
        for c in [r["cluster"] for r in far.select("cluster").distinct().orderBy("cluster").collect()]:
            rows = far.where(F.col("cluster") == c).orderBy("position").collect()  # 15 rows
            parts.append(bars([(f"{r['feature']}, {'above' if r['z'] >= 0 else 'below'}", r["z"], 0 if r["z"] >= 0 else 7) for r in rows], f"Cluster {c}: features farthest from the mean of all rows, in deviations"))
    if there("consensus_vs_best_base"):
        long = views.side_by_side(read("consensus_vs_best_base")).orderBy("metric", "algorithm").collect()  # two rows a measure
        parts.append("<h2>Evaluation</h2>")
        for m in dict.fromkeys(r["metric"] for r in long):
            parts.append(bars([(r["algorithm"], r["value"], 0 if r["algorithm"] == "Consensus" else 1) for r in long if r["metric"] == m], m.replace("_", " ")))
    if there("scoreboard"):
        parts += ["<h2>Portfolio</h2>", table(read("scoreboard").orderBy("final_order"))]
    if there("drift"):
        moved = views.drift_order(read("drift")).orderBy("position")
        parts += ["<h2>Drift</h2>", bars([(f"{r['feature']} ({r['status']})", r["psi"], 0) for r in moved.limit(ROWS).collect() if r["psi"] is not None], "population stability index"), table(moved.drop("position"))]
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Segmentation</title><style>{STYLE}</style></head><body>{"".join(parts)}<script>{SCRIPT}</script></body></html>'


def assign_record(spark: SparkSession, out: str, record: dict[str, float]) -> DataFrame:
    """(row_id, cluster, distance, nearest) of one record typed in by hand; a value that isn't given is zero, Amount one."""
    unknown = sorted(set(record) - set(RAW_COLUMNS))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    names = [c for c in RAW_COLUMNS if c != "Class"]
    row = (0, *(float(record.get(c, 1.0 if c == "Amount" else 0.0)) for c in names))
    own = spark.createDataFrame([row], "row_id long, " + ", ".join(f"{c} double" for c in names))
    return views.distances(flows.assign(spark, own, out)).orderBy("distance", "cluster")
