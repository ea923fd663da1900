"""Text renderings of result tables: collected rows to Markdown.  For reports of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph

#: Labels of the rendered texts.
EDGE = {"body": "link no corpo", "related": "frontmatter related"}
RELATION = {"bidirectional": "bidirecional", "declared": "declarado em related", "links-to": "aponta para", "linked-from": "apontado por"}


def graph_text(pages: DataFrame, edge: DataFrame, style: str = "summary") -> str:
    """``summary``, ``full`` or ``mermaid``."""
    if style not in ("summary", "full", "mermaid"):
        raise ValueError(f"no style {style!r}")
    if style == "mermaid":
        return _mermaid(pages, edge)
    values = {r.metric: r.value for r in graph.summary(pages, edge).collect()}
    top = graph.hubs(pages, edge).collect()
    hubs = [f"{i}. `{h.slug}` — {h.in_degree} entradas, {h.out_degree} saídas" for i, h in enumerate(top, 1)] or ["_Nenhum link entre páginas ainda._"]
    text = "\n".join(["# Grafo da Wiki\n", f"- Páginas (nós): {values['nodes']}", f"- Links (arestas): {values['edges']}", f"- Páginas órfãs: {values['orphans']}", f"- Links quebrados: {values['broken_links']}", "", "## Hubs (maior conectividade)\n", *hubs])
    return text if style == "summary" else text + "\n\n## Adjacência\n" + _adjacency(pages, edge)


def _adjacency(pages: DataFrame, edge: DataFrame) -> str:
    ends = edge.select(F.explode(F.array(F.struct(F.col("src").alias("slug"), F.lit(0).alias("way"), F.col("dst").alias("other"), "kind"), F.struct(F.col("dst").alias("slug"), F.lit(1).alias("way"), F.col("src").alias("other"), "kind"))).alias("x")).select("x.*")
    lists = ends.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("way", "other", "kind"))).alias("ends"))
    out = []
    for row in pages.select("slug").join(lists, "slug", "left").orderBy("slug").collect():
        out.append(f"\n### `{row.slug}`\n")
        if not row.ends:
            out.append("- _sem links_\n")
        for way, label in ((0, "aponta para"), (1, "apontado por")):
            if items := [f"`{e.other}` ({EDGE[e.kind]})" for e in row.ends or [] if e.way == way]:
                out.append(f"- {label}: {', '.join(items)}\n")
    return "".join(out)


def _mermaid(pages: DataFrame, edge: DataFrame) -> str:
    ids = {r.slug: f"n{i}" for i, r in enumerate(pages.select("slug").distinct().orderBy("slug").collect())}
    arrows = sorted(f"  {ids[e.src]} {'-->' if e.kind == 'body' else '-.->'} {ids[e.dst]}" for e in edge.collect() if e.src in ids and e.dst in ids)
    return "\n".join(["```mermaid", "graph LR", *(f'  {i}["{slug}"]' for slug, i in ids.items()), *arrows, "```"])


def index_page(pages: DataFrame) -> str:
    """The catalogue page: pages by type, then by project."""
    rows = pages.where("slug <> 'index'").select("slug", "type", "project", "status").orderBy("slug").collect()
    out = ["# Index", ""]
    for title, key, other, spare in (("## Por Tipo", "type", "project", "(sem tipo)"), ("## Por Projeto", "project", "type", None)):
        groups: dict[str, list] = {}
        for r in rows:
            if r[key] is not None:
                groups.setdefault(r[key], []).append(r)
        named = sorted(groups.items())
        rest = [r for r in rows if r[key] is None]
        if spare and rest:
            named.append((spare, rest))
        if named:
            out += [title, ""]
        for name, own in named:
            out += [f"### {name}", ""]
            for r in own:
                meta = ", ".join(f"{k}: {r[k]}" for k in (other, "status") if r[k])
                out.append(f"- [[{r.slug}]]" + (f" — {meta}" if meta else ""))
            out.append("")
    return "\n".join(out)


def hits_text(hits: DataFrame) -> str:
    """A result list, best first."""
    rows = hits.orderBy("position").collect()
    return "\n".join(f"{r.position}. {r.slug} (score: {r.score:.4f})" for r in rows) or "Nenhum resultado."


def lint_text(findings: DataFrame) -> str:
    """Findings grouped by check."""
    out: list[str] = ["# Lint"]
    last = None
    for r in findings.orderBy("check", "slug", "target").collect():
        if r.check != last:
            out += ["", f"## {r.check}", ""]
            last = r.check
        more = (f" → `{r.target}`" if r.target else "") + (f" ({r.metric:g})" if r.metric is not None else "")
        out.append(f"- `{r.slug}`{more}")
    return "\n".join(out)
