"""Queries of the graph library, by name, with their SQL where SQL can express them."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.hashrand import uniform_sql
from graphloom.graph import Graph
from graphloom.operators import algebra, centrality, cliques, community, components, distance, dynamic, flows, generators, hyperbolic, linkpred, matching, sparsify, stats, traversal
from graphloom.operators import triangles as tri
from graphloom.plans import fixtures as fx
from graphloom.plans.fixpoint import shared_dir
from graphloom.plans.fixtures import sql
from graphloom.plans.registry import ORACLES, QUERIES, query
from graphloom.sources import readers, writers
from graphloom.sources.readers import read_graph, read_graphs
from graphloom.sources.writers import convert, write_graph

def _round(df: DataFrame, *cols: str, by: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, by) for c in cols})


def pp(s, d):
    return fx.co_orders(s, d)


def ppc(s, d):
    """pp, derived once for plans that read it several times."""
    return pp(s, d).cut()


def pp2(s, d):
    return fx.co_orders(s, d, 2).cut()


# -- the graph container
query("graph_degree", sql("pp", " select id, deg::bigint as deg, wdeg from deg"))(lambda s, d: pp(s, d).degrees().select("id", "deg", "wdeg"))
query("graph_volume", sql("pp2", " select id, coalesce(sum(case when src = dst then 2 * w else w end), 0.0) as vol from nodes left join bo on src = id group by id"))(lambda s, d: pp2(s, d).degrees().select("id", F.col("vol").cast("double").alias("vol")))
query("graph_in_degree", sql("seq", " select id, count(e.src) as deg from nodes left join e on e.dst = id group by id"))(lambda s, d: fx.sequences(s, d).in_degrees())
query("graph_summary", sql("pp", " select (select count(*) from nodes) as n, count(*) as m, count(*) filter (where src = dst) as loops, sum(w) as weight, round(count(*) / ((select count(*) from nodes) * ((select count(*) from nodes) - 1) / 2.0), 9) as density from e"))(lambda s, d: _round(pp(s, d).summary(), "density", by=9))
query("graph_isolated", sql("pp2", " select id from deg where deg = 0"))(lambda s, d: pp2(s, d).isolated())
query("graph_subgraph", sql("pp", " select e.src, e.dst, e.w from e join part a on a.p_partkey = src join part b on b.p_partkey = dst where a.p_size <= 10 and b.p_size <= 10"))(lambda s, d: pp(s, d).subgraph(fx.table(s, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id"))).edges)
query("graph_transpose", sql("seq", " select dst as src, src as dst, w from e"))(lambda s, d: fx.sequences(s, d).transpose().edges)
query("graph_to_undirected", sql("seq", " select least(src, dst) as src, greatest(src, dst) as dst, sum(w) as w from e group by 1, 2"))(lambda s, d: fx.sequences(s, d).to_undirected().edges)
query("graph_merge", sql("pp2", ", f as (select least(p, s) as src, greatest(p, s) as dst from (select distinct l_partkey as p, l_suppkey as s from lineitem)), f2 as (select distinct src, dst from f) select coalesce(e.src, f2.src) as src, coalesce(e.dst, f2.dst) as dst, coalesce(e.w, 1.0) as w from e full join f2 on e.src = f2.src and e.dst = f2.dst"))(
    lambda s, d: pp2(s, d).merge(Graph.from_edges(fx.part_suppliers(s, d).select(F.col("p").alias("src"), F.col("s").alias("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())).edges
)
query("graph_compact_ids", sql("pp2", " select id, (row_number() over (order by id) - 1)::bigint as new_id from deg where deg > 0"))(lambda s, d: Graph.from_edges(pp2(s, d).edges).compact_ids())
query("graph_index_edges", sql("pp2", " select src, dst, w, (row_number() over (order by src, dst) - 1)::bigint as eid from e"))(lambda s, d: pp2(s, d).index_edges())
query("graph_contract", sql("pp", " select least(a.subset, b.subset) as src, greatest(a.subset, b.subset) as dst, sum(w) as w from e join br a on a.id = e.src join br b on b.id = e.dst group by 1, 2"))(lambda s, d: pp(s, d).contract(fx.brands(s, d)).edges)
query("graph_neighbors", sql("pp", " select bo.src, bo.dst, bo.w from bo join part on p_partkey = src where p_size = 1"))(lambda s, d: pp(s, d).neighbors(fx.table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"))))
query("graph_random_edges", sql("pp", f" select src, dst, w from e order by {uniform_sql('edge3', 'src', 'dst')}, src, dst limit 100"))(lambda s, d: pp(s, d).random_edges(100, 3))
query("graph_random_neighbors", sql("pp", f" select src as id, arg_min(dst, {uniform_sql('next1', 'src', 'dst')}) as neighbor from bo group by src"))(lambda s, d: pp(s, d).random_neighbors(1))
query("graph_upsert", sql("pp2", ", f as (select src, dst, w from pp where w >= 3) select e.src, e.dst, e.w + coalesce(f.w, 0.0) as w from e left join f on e.src = f.src and e.dst = f.dst"))(lambda s, d: pp2(s, d).upsert_edges(fx.co_orders(s, d, 3).edges, add=True).edges)
query("graph_remove_edges", sql("pp2", " select src, dst, w from e where w < 3"))(lambda s, d: pp2(s, d).remove_edges(fx.co_orders(s, d, 3).edges).edges)

# -- traversal
_SRC = "(select min(src) as s from e)"
_BFS = f", r(id, d) as (select s, 0 from {_SRC} union select bo.dst, r.d + 1 from r join bo on bo.src = r.id where r.d < 40), dist as (select id, min(d)::bigint as dist from r group by id)"


def _first(g: Graph) -> DataFrame:
    return g.edges.agg(F.min("src").alias("id"))


query("bfs_distances", sql("pp2", f"{_BFS} select id, dist from dist", True))(lambda s, d: traversal.bfs(g := pp2(s, d), _first(g)).select("id", "dist"))
query("bfs_multi_source", sql("pp2", ", r(s, id, d) as (select id, id, 0 from nodes union select r.s, bo.dst, r.d + 1 from r join bo on bo.src = r.id where r.d < 3) select s as source, id, min(d)::bigint as dist from r group by 1, 2", True))(lambda s, d: traversal.bfs(g := pp2(s, d), g.nodes, 3).select("source", "id", "dist"))
query("bfs_path_counts")(lambda s, d: traversal.bfs(g := pp2(s, d), _first(g)).select("id", "paths"))
query("bfs_tree", sql("pp2", f"{_BFS} select min(bo.src) as src, a.id as dst from dist a join bo on bo.dst = a.id join dist b on b.id = bo.src and b.dist + 1 = a.dist group by a.id", True))(lambda s, d: traversal.bfs_tree(g := pp2(s, d), _first(g)).select("src", "dst"))


def _costly(g: Graph) -> Graph:
    return Graph(g.nodes, g.edges.select("src", "dst", (1 + (F.col("src") * 7 + F.col("dst") * 13) % 5).cast("double").alias("w")))


query("dijkstra_distances", sql("pp2", f", c as (select src, dst, (1 + (least(src, dst) * 7 + greatest(src, dst) * 13) % 5)::double as w from bo), r(id, d) as (select s, 0.0::double from {_SRC} union select c.dst, r.d + c.w from r join c on c.src = r.id where r.d < 40) select id, min(d) as dist from r group by id", True))(lambda s, d: traversal.dijkstra(g := _costly(pp2(s, d)), _first(g)).select("id", "dist"))
query("dyn_bfs_insertions")(lambda s, d: (lambda g, h: traversal.relax_insertions(h.unweighted(), traversal.bfs(h, _first(g)).select("source", "id", F.col("dist").cast("double").alias("dist")), g.edges.where("w < 3").withColumn("w", F.lit(1.0))).select("id", "dist"))(pp2(s, d), fx.co_orders(s, d, 3).cut()))

# -- components and forests
_CC = ", r(id, c) as (select id, id from nodes union select bo.dst, r.c from r join bo on bo.src = r.id and r.c < bo.dst), cc as (select id, min(c) as component from r group by id)"
query("connected_components", sql("pp2", f"{_CC} select id, component from cc", True))(lambda s, d: components.connected_components(pp2(s, d)))
query("component_sizes", sql("pp2", f"{_CC} select component, count(*) as size from cc group by component", True))(lambda s, d: components.component_sizes(pp2(s, d)))
query("largest_component", sql("pp2", f"{_CC}, t as (select component from cc group by component order by count(*) desc, component limit 1) select id from cc join t using (component)", True))(lambda s, d: components.largest_component(pp2(s, d)).nodes)
query("strong_components", sql("seq", ", r(s, id) as (select id, id from nodes union select r.s, e.dst from r join e on e.src = r.id) select a.s as id, min(a.id) as component from r a join r b on a.id = b.s and b.id = a.s group by a.s", True))(lambda s, d: components.strong_components(fx.sequences(s, d)))
query("max_spanning_forest")(lambda s, d: components.maximum_forest(pp2(s, d)).agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("edges")))
query("union_max_forest")(lambda s, d: components.union_maximum_forest(pp2(s, d)))
query("random_spanning_forest")(lambda s, d: components.random_forest(pp2(s, d), 1))
query("bfs_forest")(lambda s, d: components.bfs_forest(pp2(s, d)))

# -- triangles
_TRI = ", tr as (select a.src, a.dst, count(*) as t from e a join bo x on x.src = a.src join bo y on y.src = a.dst and y.dst = x.dst group by 1, 2), ts as (select e.src, e.dst, e.w, coalesce(t, 0)::bigint as t, a.deg as du, b.deg as dv from e left join tr on tr.src = e.src and tr.dst = e.dst join deg a on a.id = e.src join deg b on b.id = e.dst)"
_LCC = f"{_TRI}, nt as (select id, sum(t) / 2 as t from (select src as id, t from ts union all select dst, t from ts) group by id), lc as (select deg.id, deg, coalesce(t, 0) as t, case when deg > 1 then 2.0 * coalesce(t, 0) / (deg * (deg - 1)) else 0.0 end as lcc from deg left join nt on nt.id = deg.id)"
query("lcc_topk", sql("pp", f"{_LCC} select id, round(lcc, 6) as lcc from lc order by round(lcc, 9) desc, id limit 20"))(lambda s, d: _round(tri.local_clustering(ppc(s, d)).orderBy(F.round("lcc", 9).desc(), "id").limit(20), "lcc"))
query("local_clustering", sql("pp", f"{_LCC} select id, round(lcc, 6) as lcc from lc"))(lambda s, d: _round(tri.local_clustering(ppc(s, d)), "lcc"))
query("global_clustering", sql("pp", f"{_LCC} select round(sum(2.0 * t) / sum(deg * (deg - 1)), 6) as closed, round(avg(lcc) filter (where deg > 1), 6) as mean_local from lc"))(lambda s, d: _round(tri.global_clustering(ppc(s, d)), "closed", "mean_local"))
query("clustering_sampled", sql("pp2", f", dw as (select id, deg as d, deg * (deg - 1) as pairs from deg where deg > 1), up as (select *, (sum(pairs) over (order by id))::bigint as upto from dw), dr as (select range as draw, floor({uniform_sql('wedge0', 'range')} * t)::bigint as place from range(2000), (select max(upto) as t from up)), ce as (select draw, id, (place - upto + pairs) % d as a, (place - upto + pairs) // d as b from dr join up on place >= upto - pairs and place < upto), nb as (select src, dst, row_number() over (partition by src order by dst) - 1 as r from bo) select avg((exists (select 1 from bo where bo.src = x.dst and bo.dst = y.dst))::int) as closed from ce join nb x on x.src = id and x.r = a join nb y on y.src = id and y.r = b + (b >= a)::bigint"))(lambda s, d: tri.sampled_clustering(pp2(s, d), 2000))
query("triangle_edge_score", sql("pp", f"{_TRI} select src, dst, t from ts"))(lambda s, d: tri.triangle_scores(ppc(s, d)))
query("quadrangle_edge_score", sql("pp2", ", q as (select e.src, e.dst, count(*) as q from e join bo x on x.src = e.src and x.dst <> e.dst join bo y on y.src = e.dst and y.dst <> e.src join bo z on z.src = x.dst and z.dst = y.dst where x.dst <> y.dst group by 1, 2) select e.src, e.dst, coalesce(q, 0)::bigint as q from e left join q on q.src = e.src and q.dst = e.dst"))(lambda s, d: tri.quadrangle_scores(pp2(s, d)))
query("edge_scan", sql("pp", f"{_TRI} select src, dst, round((t + 1) / sqrt((du + 1.0) * (dv + 1.0)), 6) as score from ts"))(lambda s, d: _round(tri.scan_similarity(ppc(s, d)), "score"))
query("edge_jaccard", sql("pp", f"{_TRI} select src, dst, round(1 - t / (du + dv - t)::double, 6) as score from ts"))(lambda s, d: _round(tri.jaccard_distance(ppc(s, d)), "score"))
query("edge_chance_corrected", sql("pp", f"{_TRI} select src, dst, case when t > 0 then t * ((select count(*) from nodes) - 2) / ((du - 1)::double * (dv - 1)::double) when du = 1 or dv = 1 then 1.0 else 0.0 end as score from ts"))(lambda s, d: tri.chance_corrected(ppc(s, d)))
query("edge_adamic_adar", sql("pp", ", tr as (select a.src, a.dst, sum(1 / ln(deg)) as s from e a join bo x on x.src = a.src join bo y on y.src = a.dst and y.dst = x.dst join deg on deg.id = x.dst group by 1, 2) select e.src, e.dst, round(1 / s, 6) as score from e left join tr on tr.src = e.src and tr.dst = e.dst"))(lambda s, d: _round(tri.adamic_adar_distance(ppc(s, d)), "score"))


def _weights(g: Graph) -> DataFrame:
    return g.edges.select("src", "dst", F.col("w").alias("score"))


query("edge_geometric_mean", sql("pp", " select e.src, e.dst, round(e.w / sqrt(a.wdeg * b.wdeg), 6) as score from e join deg a on a.id = e.src join deg b on b.id = e.dst"))(lambda s, d: _round(tri.geometric_mean(g := ppc(s, d), _weights(g)), "score"))
query("edge_normalize", sql("pp", " select src, dst, round(1 - (w - (select min(w) from e)) / ((select max(w) from e) - (select min(w) from e)), 6) as score from e"))(lambda s, d: _round(tri.normalized(_weights(ppc(s, d)), invert=True), "score"))
query("edge_linearize", sql("pp", " select src, dst, round((row_number() over (order by w, src, dst) - 1) / (count(*) over () - 1)::double, 6) as score from e"))(lambda s, d: _round(tri.linearized(_weights(ppc(s, d))), "score"))
query("edge_blend", sql("pp", " select src, dst, case when w >= 2 then 10 * w else w end as score from e"))(lambda s, d: tri.blended(w := _weights(g := ppc(s, d)), w.withColumn("score", 10 * F.col("score")), g.edges.where("w >= 2")))
query("edge_as_weight", sql("pp", f"{_TRI} select src, dst, 1.0 + 2.0 * t as w from ts"))(lambda s, d: tri.as_weight(g := ppc(s, d), tri.triangle_scores(g).withColumnRenamed("t", "score"), 1.0, 2.0).edges)
query("edge_modularity_scoring", sql("pp", " select e.src, e.dst, round(e.w / t - a.wdeg / (2 * t) * b.wdeg / (2 * t), 9) as score from e join deg a on a.id = e.src join deg b on b.id = e.dst, (select sum(w) as t from e)"))(
    lambda s, d: (lambda g: _round(tri.with_degrees(g, g.edges).join(F.broadcast(g.edges.agg(F.sum("w").alias("t")))).select("src", "dst", (F.col("w") / F.col("t") - F.col("su") / (2 * F.col("t")) * F.col("sv") / (2 * F.col("t"))).alias("score")), "score", by=9))(ppc(s, d))
)
query("edge_prefix_jaccard")(lambda s, d: _round(tri.prefix_jaccard(g := pp2(s, d), _weights(g)), "score"))

# -- sparsification
_SIDE = ", si as (select src as ego, dst as alter, {v} as score from {t} union all select dst, src, {v} from {t})"
_LR = "case when d = 1 then 1.0 else 1 - ln(r) / ln(d) end"
_BEST = " select least(ego, alter) as src, greatest(ego, alter) as dst, round(max(v), 6) as score from rk group by 1, 2"
query("sparsify_local_degree", sql("pp", f", rk as (select ego, alter, {_LR} as v from (select bo.src as ego, bo.dst as alter, rank() over (partition by bo.src order by deg desc) as r, count(*) over (partition by bo.src) as d from bo join deg on deg.id = bo.dst)){_BEST}"))(lambda s, d: _round(sparsify.local_degree(ppc(s, d)), "score"))
query("sparsify_local_filter", sql("pp", f"{_SIDE.format(v='w', t='e')}, rk as (select ego, alter, {_LR} as v from (select ego, alter, rank() over (partition by ego order by score desc) as r, count(*) over (partition by ego) as d from si)){_BEST}"))(lambda s, d: _round(sparsify.local_filter(g := ppc(s, d), _weights(g)), "score"))
query("sparsify_local_similarity", sql("pp", f"{_TRI}{_SIDE.format(v='t / (du + dv - t)::double', t='ts')}, rk as (select ego, alter, {_LR} as v from (select ego, alter, row_number() over (partition by ego order by score desc, alter) as r, count(*) over (partition by ego) as d from si)){_BEST}"))(lambda s, d: _round(sparsify.local_similarity(ppc(s, d)), "score"))
query("sparsify_multiscale", sql("pp", " select e.src, e.dst, round(greatest(1 - pow(1 - e.w / a.wdeg, a.deg - 1), 1 - pow(1 - e.w / b.wdeg, b.deg - 1)), 6) as score from e join deg a on a.id = e.src join deg b on b.id = e.dst"))(lambda s, d: _round(sparsify.multiscale(ppc(s, d)), "score"))
query("sparsify_simmelian_overlap", sql("pp", f"{_TRI}{_SIDE.format(v='t', t='ts')}, tp as (select ego, alter from (select ego, alter, row_number() over (partition by ego order by score desc, alter desc) as p from si) where p <= 10) select e.src, e.dst, coalesce(n, 0)::double as score from e left join (select e.src, e.dst, count(*) as n from e join tp a on a.ego = e.src join tp b on b.ego = e.dst and b.alter = a.alter group by 1, 2) q on q.src = e.src and q.dst = e.dst"))(
    lambda s, d: sparsify.simmelian_overlap(g := ppc(s, d), tri.triangle_scores(g).withColumnRenamed("t", "score"), 10)
)
query("sparsify_threshold", sql("pp", f"{_TRI} select src, dst, w from ts where t >= 8"))(lambda s, d: sparsify.triangle_sparsifier(ppc(s, d), 8.0).edges)
query("sparsify_random", sql("pp", f" select src, dst, w from e where {uniform_sql('edge0', 'src', 'dst')} >= 0.5"))(lambda s, d: sparsify.random_sparsifier(ppc(s, d), 0.5).edges)
query("sparsify_to_size", sql("pp", " select src, dst, w from e order by w desc, src, dst limit (select round_even(count(*) * 0.1, 0)::bigint from e)"))(lambda s, d: sparsify.to_size(g := ppc(s, d), _weights(g), 0.1).edges)
query("sparsify_scan", sql("pp", f"{_TRI} select src, dst, w from ts where (t + 1) / sqrt((du + 1.0) * (dv + 1.0)) >= 0.1003"))(lambda s, d: sparsify.scan_sparsifier(ppc(s, d), 0.1003).edges)
query("sparsify_simmelian")(lambda s, d: sparsify.simmelian(pp2(s, d), 0.2).edges)
query("sparsify_quadrilateral")(lambda s, d: sparsify.quadrilateral_simmelian(pp2(s, d), 0.2).edges)
query("sparsify_forest_fire")(lambda s, d: sparsify.forest_fire(pp2(s, d)))
query("sparsify_random_node_edge")(lambda s, d: sparsify.random_node_edge(pp2(s, d)))
query("sparsify_simmelian_multiscale")(lambda s, d: sparsify.simmelian_multiscale(ppc(s, d), 0.8).edges)
query("sparsify_degree_multiscale")(lambda s, d: sparsify.degree_multiscale(pp2(s, d), 0.5).edges)

# -- centrality
query("degree_centrality", sql("pp", " select id, round(deg / ((select count(*) from nodes) - 1)::double, 9) as score from deg"))(lambda s, d: _round(centrality.degree(pp(s, d), True), "score", by=9))
query("centrality_ranking", sql("pp", " select id, deg::double as score, round(rank() over (order by deg desc) + (count(*) over (partition by deg) - 1) / 2.0, 3)::double as rank from deg"))(lambda s, d: centrality.ranking(centrality.degree(pp(s, d))).withColumn("rank", F.col("rank").cast("double")))
query("centralization", sql("pp", " select round((count(*) * max(deg) - sum(deg)) / (count(*) * (count(*) - 1.0) - sum(deg)), 9) as centralization from deg"))(lambda s, d: (lambda g: _round(centrality.centralization(centrality.degree(g), g.nodes.count() - 1.0), "centralization", by=9))(pp(s, d)))
_AP = ", r(s, id, d) as (select id, id, 0 from nodes union select r.s, bo.dst, r.d + 1 from r join bo on bo.src = r.id where r.d < 22), ap as (select s, id, min(d) as d from r group by 1, 2)"
query("closeness", sql("pp2", f"{_AP} select s as id, round(1 / nullif(sum(d), 0)::double, 9) as score from ap group by s", True))(lambda s, d: _round(centrality.closeness(pp2(s, d)), "score", by=9))
query("top_closeness", sql("pp2", f"{_AP} select s as id, round(1 / nullif(sum(d), 0)::double, 9) as score from ap group by s order by 2 desc nulls last, id limit 10", True))(lambda s, d: _round(centrality.top_closeness(pp2(s, d), 10), "score", by=9))
query("eccentricity", sql("pp2", f"{_AP} select s as id, max(d)::bigint as ecc, min(id) filter (where d = m) as farthest from (select *, max(d) over (partition by s) as m from ap) group by s", True))(lambda s, d: distance.eccentricity(pp2(s, d)).select("id", "ecc", "farthest"))
query("diameter", sql("pp2", f"{_AP} select max(d)::bigint as diameter from ap", True))(lambda s, d: distance.diameter(pp2(s, d)))
query("neighborhood_function", sql("pp2", f"{_AP} select d::bigint as h, (sum(count(*)) over (order by d))::bigint as pairs from ap where d > 0 group by d", True))(lambda s, d: distance.neighborhood_function(pp2(s, d)))
query("hop_plot", sql("pp2", f"{_AP} select d::bigint as h, round(sum(count(*)) over (order by d) / sum(count(*)) over ()::double, 6) as share from ap group by d", True))(lambda s, d: _round(distance.hop_plot(pp2(s, d)), "share"))
query("effective_diameter")(lambda s, d: distance.effective_diameter(components.largest_components(pp2(s, d)).cut()))
query("betweenness_pivots")(lambda s, d: _round(centrality.approx_betweenness(pp2(s, d), 16), "score"))
query("approx_closeness")(lambda s, d: _round(centrality.approx_closeness(pp2(s, d), 16), "score", by=9))


def _unrolled(step: str, rounds: int, last: str) -> str:
    return "".join(f", x{i + 1} as ({step.replace('PREV', f'x{i}')})" for i in range(rounds)) + last.replace("LAST", f"x{rounds}")


query("pagerank_10", sql("pp", ", x0 as (select id, 1.0 / (select count(*) from nodes) as s from nodes)" + _unrolled("select n.id, 0.15 / (select count(*) from nodes) + 0.85 * coalesce(sum(p.s * bo.w / g.wdeg), 0) as s from nodes n left join bo on bo.dst = n.id left join PREV p on p.id = bo.src left join deg g on g.id = bo.src group by n.id", 10, " select id, round(s / (select sum(s) from LAST), 9) as score from LAST")))(lambda s, d: _round(centrality.pagerank(ppc(s, d), tol=-1.0, rounds=10), "score", by=9))
query("eigenvector_10", sql("pp", ", x0 as (select id, 1.0::double as s from nodes)" + _unrolled("select id, s / sqrt(sum(s * s) over ()) as s from (select n.id, coalesce(sum(p.s * bo.w), 0) as s from nodes n left join bo on bo.dst = n.id left join PREV p on p.id = bo.src group by n.id)", 10, " select id, round(s, 6) as score from LAST")))(lambda s, d: _round(centrality.eigenvector(ppc(s, d), tol=-1.0, rounds=10), "score"))
query("katz_10", sql("pp", ", x0 as (select id, 1.0::double as s from nodes)" + _unrolled("select id, s / sqrt(sum(s * s) over ()) as s from (select n.id, 0.1 + 5e-4 * coalesce(sum(p.s * bo.w), 0) as s from nodes n left join bo on bo.dst = n.id left join PREV p on p.id = bo.src group by n.id)", 10, " select id, round(s, 6) as score from LAST")))(lambda s, d: _round(centrality.katz(ppc(s, d), tol=-1.0, rounds=10), "score"))
query("core_numbers")(lambda s, d: centrality.core_numbers(ppc(s, d)))
query("sfigality", sql("pp", " select n.id, round(avg((b.deg > a.deg)::int), 6) as score from nodes n left join bo on bo.src = n.id left join deg a on a.id = bo.src left join deg b on b.id = bo.dst group by n.id"))(lambda s, d: _round(centrality.sfigality(ppc(s, d)), "score"))
query("partition_coverage", sql("pp", " select n.id, round(sum(case when a.subset = b.subset then w else 0 end) / sum(w), 6) as score from nodes n left join bo on bo.src = n.id left join br a on a.id = bo.src left join br b on b.id = bo.dst group by n.id"))(lambda s, d: _round(centrality.partition_coverage(pp(s, d), fx.brands(s, d)), "score"))
query("permanence", sql("pp", ", x as (select bo.src, bo.dst, a.subset as p, b.subset as q from bo join br a on a.id = bo.src join br b on b.id = bo.dst), k as (select src, p, q, count(*) as k from x group by 1, 2, 3), ba as (select src as id, sum(k) as deg, sum(case when p = q then k else 0 end) as inn, max(case when p <> q then k else 0 end) as most from k group by src), t as (select a.src as id, count(*) as t from x a join x b on a.src = b.src and a.p = a.q and b.p = b.q and a.dst < b.dst join e on e.src = a.dst and e.dst = b.dst group by 1) select ba.id, round(inn / greatest(most, 1)::double / deg - (1 - case when inn > 1 then 2.0 * coalesce(t, 0) / (inn * (inn - 1)) else 0 end), 6) as score from ba left join t on t.id = ba.id"))(lambda s, d: _round(centrality.permanence(ppc(s, d), fx.brands(s, d)), "score"))
query("kpath_centrality")(lambda s, d: centrality.kpath(pp2(s, d)))
query("spanning_edge_centrality")(lambda s, d: centrality.spanning_edge(pp2(s, d), 4))
query("assortativity_numeric", sql("pp", " select round(corr(a.p_size, b.p_size), 6) as assortativity from e join part a on a.p_partkey = src join part b on b.p_partkey = dst"))(lambda s, d: _round(centrality.assortativity_numeric(pp(s, d), fx.sizes(s, d).withColumnRenamed("subset", "value")), "assortativity"))
query("assortativity_nominal", sql("pp", ", k as (select a.subset as p, b.subset as q, count(*)::double as k from e join br a on a.id = src join br b on b.id = dst group by 1, 2), m as (select sum(k) as m from k) select round(((select sum(k) from k where p = q) / m - ab) / (1 - ab), 6) as assortativity from m, (select sum(r.a * c.b) / (any_value(m) * any_value(m)) as ab from (select p, sum(k) as a from k group by p) r join (select q, sum(k) as b from k group by q) c on r.p = c.q, m)"))(lambda s, d: _round(centrality.assortativity_nominal(pp(s, d), fx.brands(s, d)), "assortativity"))
query("algebraic_distance")(lambda s, d: _round(distance.algebraic_distance(pp2(s, d), systems=4, rounds=8), "score"))
query("approx_neighborhood_function")(lambda s, d: distance.approx_neighborhood_function(pp2(s, d), masks=8))

# -- communities
query("label_propagation")(lambda s, d: community.label_propagation(pp2(s, d)))
query("degree_ordered_propagation")(lambda s, d: community.degree_ordered_propagation(pp2(s, d)))
query("louvain")(lambda s, d: community.louvain(pp2(s, d)))
query("agglomerative")(lambda s, d: community.agglomerate(pp2(s, d)))
_LAB = ", la as (select e.src, e.dst, e.w, a.subset as p, b.subset as q from e join br a on a.id = e.src join br b on b.id = e.dst)"
_SUB = f"{_LAB}, su as (select subset, count(*) as size from br group by 1), ed as (select p as s, q as o, w from la union all select q, p, w from la), st as (select su.subset, size, coalesce(sum(case when s = o then w else 0 end), 0) / 2 as inn, coalesce(sum((s = o)::int), 0) / 2 as ie, coalesce(sum(case when s <> o then w else 0 end), 0) as cut, coalesce(sum(w), 0) as vol from su left join ed on ed.s = su.subset group by 1, 2)"
query("q_modularity", sql("pp", f"{_SUB} select round((select sum(w) filter (where p = q) / sum(w) from la) - sum(vol * vol) / (4 * (select sum(w) from e) * (select sum(w) from e)), 9) as modularity from st"))(lambda s, d: _round(community.modularity(pp(s, d), fx.brands(s, d)), "modularity", by=9))
query("q_coverage", sql("pp", f"{_LAB} select round(sum(w) filter (where p = q) / sum(w), 6) as coverage from la"))(lambda s, d: _round(community.coverage(pp(s, d), fx.brands(s, d)), "coverage"))
query("q_edge_cut", sql("pp", f"{_LAB} select sum(w) filter (where p <> q) as cut from la"))(lambda s, d: community.edge_cut(pp(s, d), fx.brands(s, d)))
for _name, _fun, _expr in (
    ("q_conductance", community.isolated_conductance, "case when least(vol, 2 * (select sum(w) from e) - vol) > 0 then cut / least(vol, 2 * (select sum(w) from e) - vol) else 0.0 end"),
    ("q_expansion", community.isolated_expansion, "case when least(size, (select count(*) from nodes) - size) > 0 then cut / least(size, (select count(*) from nodes) - size) else 0.0 end"),
    ("q_density", community.density, "case when size > 1 then ie / (size * (size - 1) / 2.0) else 1.0 end"),
):
    query(_name, sql("pp", f"{_SUB} select subset, size, round({_expr}, 6) as value from st"))(lambda s, d, f=_fun: _round(f(pp(s, d), fx.brands(s, d)), "value"))
query("q_hub_dominance", sql("pp", f"{_LAB}, su as (select subset, count(*) as size from br group by 1), h as (select p, max(k) as k from (select p, id, count(*) as k from (select p, src as id from la where p = q union all select p, dst from la where p = q) group by 1, 2) group by 1) select subset, size, round(case when size > 1 then coalesce(k, 0) / (size - 1)::double else 1.0 end, 6) as value from su left join h on p = subset"))(lambda s, d: _round(community.hub_dominance(pp(s, d), fx.brands(s, d)), "value"))
query("q_fragmentation", sql("pp2", f"{_CC} select subset, sum(k)::bigint as size, round(1 - max(k) / sum(k)::double, 6) as value from (select subset, component, count(*) as k from br join cc on cc.id = br.id group by 1, 2) group by 1", True))(lambda s, d: _round(community.fragmentation(pp2(s, d), fx.brands(s, d)), "value"))
query("q_stable_nodes", sql("pp", ", k as (select bo.src, a.subset as p, b.subset as q, sum(floor(w)) as s from bo join br a on a.id = bo.src join br b on b.id = bo.dst group by 1, 2, 3) select n.id, coalesce(max(case when p = q then s else 0 end) > max(case when p <> q then s else 0 end), true) as stable from nodes n left join k on k.src = n.id group by n.id"))(lambda s, d: community.stable_nodes(pp(s, d), fx.brands(s, d)))
query("q_averages", sql("pp", f"{_SUB}, v as (select size, case when size > 1 then ie / (size * (size - 1) / 2.0) else 1.0 end as value from st) select round(sum(value * size) / sum(size), 6) as weighted, round(avg(value), 6) as unweighted, round(min(value), 6) as least, round(max(value), 6) as greatest from v"))(lambda s, d: _round(community.averaged(community.density(pp(s, d), fx.brands(s, d))), "weighted", "unweighted", "least", "greatest"))
query("q_imbalance", sql("pp2", " select round(max(k) / ceil(sum(k) / count(*)::double), 6) as imbalance from (select subset, count(*) as k from br group by 1)"))(lambda s, d: _round(community.imbalance(fx.brands(s, d)), "imbalance"))
_CMP = ", k as (select a.subset as p, b.subset as q, count(*) as k from br a join sz b on a.id = b.id group by 1, 2), ra as (select p, sum(k) as k from k group by 1), rb as (select q, sum(k) as k from k group by 1), t as (select (select sum(k) from k)::double as n, (select sum(k * (k - 1) / 2.0) from k) as s11, (select sum(k * (k - 1) / 2.0) from ra) as sa, (select sum(k * (k - 1) / 2.0) from rb) as sb), u as (select *, n * (n - 1) / 2 as c from t)"
query("cmp_rand", sql("pp2", f"{_CMP} select round(1 - (c + 2 * s11 - sa - sb) / c, 6) as distance from u"))(lambda s, d: _round(community.rand_distance(fx.brands(s, d), fx.sizes(s, d)), "distance"))
query("cmp_jaccard", sql("pp2", f"{_CMP} select round(1 - s11 / (c - (c + s11 - sa - sb)), 6) as distance from u"))(lambda s, d: _round(community.jaccard_distance(fx.brands(s, d), fx.sizes(s, d)), "distance"))
query("cmp_adjusted_rand", sql("pp2", f"{_CMP} select round(1 - (s11 - floor(sa * sb / c)) / ((sa + sb) / 2 - floor(sa * sb / c)), 6) as distance from u"))(lambda s, d: _round(community.adjusted_rand_distance(fx.brands(s, d), fx.sizes(s, d)), "distance"))
query("cmp_nmi", sql("pp2", f"{_CMP}, h as (select (select -sum(k / n * log2(k / n)) from ra, u) as a, (select -sum(k / n * log2(k / n)) from rb, u) as b, (select -sum(k / n * log2(k / n)) from k, u) as ab) select round(1 - 2 * (a + b - ab) / (a + b), 6) as distance from h"))(lambda s, d: _round(community.nmi_distance(fx.brands(s, d), fx.sizes(s, d)), "distance"))
query("cmp_graph_rand", sql("pp", " select round(avg(((a.subset = b.subset) <> (x.subset = y.subset))::int), 6) as distance from e join br a on a.id = src join br b on b.id = dst join sz x on x.id = src join sz y on y.id = dst"))(lambda s, d: _round(community.graph_rand_distance(pp(s, d), fx.brands(s, d), fx.sizes(s, d)), "distance"))
query("partition_intersection", sql("pp2", " select a.id, min(a.id) over (partition by a.subset, b.subset) as subset from br a join sz b on a.id = b.id"))(lambda s, d: community.intersection(fx.brands(s, d), fx.sizes(s, d)))
query("partition_canonical", sql("pp2", " select id, min(id) over (partition by subset) as subset from sz"))(lambda s, d: community.canonical(fx.sizes(s, d)))
query("partition_random", sql("pp2", f" select id, floor({uniform_sql('part2', 'id')} * 7)::bigint as subset from nodes"))(lambda s, d: community.random_partition(pp2(s, d), 7, 2))
query("partition_balanced", sql("pp2", " select id, floor((row_number() over (order by id) - 1) * 7 / count(*) over ()::double)::bigint as subset from nodes"))(lambda s, d: community.balanced(pp2(s, d), 7))
query("pagerank_nibble")(lambda s, d: community.pagerank_nibble(g := pp2(s, d), _first(g)))
query("greedy_expansion")(lambda s, d: community.greedy_expansion(g := pp2(s, d), _first(g)))

# -- link prediction
_P2 = ", p2 as (select distinct a.dst as u, b.dst as v from bo a join bo b on a.src = b.src and a.dst < b.dst), pr as (select p2.u, p2.v from p2 left join e on e.src = p2.u and e.dst = p2.v where e.src is null), cn as (select pr.u, pr.v, count(*) as c, sum(1 / ln(g.deg)) as aa, sum(1.0 / g.deg) as ra from pr join bo a on a.src = pr.u join bo b on b.src = pr.v and b.dst = a.dst join deg g on g.id = a.dst group by 1, 2), f as (select cn.*, a.deg as du, b.deg as dv from cn join deg a on a.id = u join deg b on b.id = v)"
query("lp_missing_links_2", sql("pp2", f"{_P2} select u, v from pr"))(lambda s, d: linkpred.missing_links(pp2(s, d)))
for _name, _sql in (("common_neighbors", "c::double"), ("adamic_adar", "aa"), ("resource_allocation", "ra"), ("jaccard", "c / (du + dv - c)::double"), ("preferential_attachment", "(du * dv)::double"), ("neighborhood_distance", "c / sqrt(du * dv)"), ("total_neighbors", "(du + dv - c)::double"), ("u_degree", "du::double"), ("v_degree", "dv::double")):
    query(f"lp_{_name}", sql("pp2", f"{_P2} select u, v, round({_sql}, 6) as score from f"))(lambda s, d, i=_name: _round(linkpred.predict(g := pp2(s, d), linkpred.missing_links(g), i), "score"))
query("lp_adjusted_rand", sql("pp2", f"{_P2}, z as (select u, v, c::double as a, (du + dv - c)::double as b, (select count(*) from nodes) - c - 2.0 * (du + dv - c) as d from f) select u, v, round(2 * (a * d - b * b) / (2 * (a + b) * (b + d)), 6) as score from z"))(lambda s, d: _round(linkpred.adjusted_rand(g := pp2(s, d), linkpred.missing_links(g)), "score"))
query("lp_neighbors_measure", sql("pp2", f"{_P2}, rc as (select src, dst from bo union all select id, id from nodes) select pr.u, pr.v, count(*)::double as score from pr join bo a on a.src = pr.u join rc on rc.src = a.dst join bo b on b.src = pr.v and b.dst = rc.dst group by 1, 2"))(lambda s, d: linkpred.neighbors_measure(g := pp2(s, d), linkpred.missing_links(g)))
query("lp_katz")(lambda s, d: _round(linkpred.katz_index(g := pp2(s, d), linkpred.missing_links(g), 4), "score", by=9))
query("lp_top_50", sql("pp2", f"{_P2} select u, v from f order by c desc, u, v limit 50"))(lambda s, d: linkpred.by_count(linkpred.predict(g := pp2(s, d), linkpred.missing_links(g), "common_neighbors"), 50))
query("lp_same_community")(lambda s, d: linkpred.same_community(g := pp2(s, d), linkpred.missing_links(g), fx.brands(s, d)))
_TRAIN = f"tn as (select * from e order by {uniform_sql('edge5', 'src', 'dst')}, src, dst limit (select floor(count(*) * 0.7)::bigint from e)), tb as (select src, dst from tn union all select dst, src from tn), tp as (select distinct a.dst as u, b.dst as v from tb a join tb b on a.src = b.src and a.dst < b.dst), tq as (select tp.* from tp left join tn on tn.src = u and tn.dst = v where tn.src is null), sc as (select tq.u, tq.v, count(*)::double as score from tq join tb a on a.src = tq.u join tb b on b.src = tq.v and b.dst = a.dst group by 1, 2), hr as (select (e.src is not null)::int as hit, row_number() over (order by score desc, u, v) - 1 as r from sc left join e on e.src = u and e.dst = v), gr as (select i, ceil((select count(*) from hr) * i / 99.0) as cut from range(100) t(i)), cu as (select i, coalesce(sum(hit), 0) as tp, count(hit) as k from gr left join hr on r < cut group by i), to_ as (select sum(hit) as pos, count(*) - sum(hit) as neg from hr)"


def _trained(s, d):
    g = pp2(s, d)
    t = linkpred.training_graph(g, 0.7, 5).cut()
    return linkpred.predict(t, linkpred.missing_links(t), "common_neighbors"), g.edges


query("lp_roc", sql("pp2", f", {_TRAIN} select round((k - tp) / neg::double, 6) as x, round(arg_max(tp / pos::double, i), 6) as y from cu, to_ group by (k - tp) / neg::double"))(lambda s, d: _round(linkpred.roc(*_trained(s, d), points=100), "x", "y"))
query("lp_precision_recall", sql("pp2", f", {_TRAIN} select round(tp / pos::double, 6) as x, round(arg_max(case when k = 0 then 1.0 else tp / k::double end, i), 6) as y from cu, to_ group by tp / pos::double"))(lambda s, d: _round(linkpred.precision_recall(*_trained(s, d), points=100), "x", "y"))
query("lp_roc_auc")(lambda s, d: _round(linkpred.area(linkpred.roc(*_trained(s, d), points=100)), "auc"))

# -- matching, sets, cliques, flow
query("matching_local_max")(lambda s, d: matching.local_max(pp2(s, d)))
query("matching_path_growing")(lambda s, d: matching.path_growing(pp2(s, d)))
query("matching_coarsening")(lambda s, d: matching.matching_coarsening(g := pp2(s, d), matching.local_max(g)).edges)
query("independent_set")(lambda s, d: matching.luby(pp2(s, d)))
query("max_clique")(lambda s, d: cliques.max_clique(pp2(s, d)).agg(F.count(F.lit(1)).alias("size")))
query("max_flow")(lambda s, d: (lambda g, t: flows.max_flow_value(g, t[0], t[1]))(g := pp2(s, d), g.edges.agg(F.min("src"), F.max("dst")).first()))
query("cut_clustering")(lambda s, d: flows.cut_clustering(fx.suppliers(s, d).cut(), 60.0, 128))

# -- generators
_N = "(select count(*) from part)"


def _n(s, d):
    return fx.parts(s, d).count()


query("gen_ring_lattice", f"select distinct least(i, (i + k) % n) as src, greatest(i, (i + k) % n) as dst, 1.0::double as w from (select unnest(range({_N})) as i, {_N} as n), range(1, 4) t(k)")(lambda s, d: generators.ring_lattice(s, _n(s, d), 3).edges)
query("gen_watts_strogatz", f"with l as (select distinct least(i, (i + k) % n) as src, greatest(i, (i + k) % n) as dst, n from (select unnest(range({_N})) as i, {_N} as n), range(1, 4) t(k)), m as (select src, case when {uniform_sql('re4', 'src', 'dst')} < 0.1 then floor({uniform_sql('to4', 'src', 'dst')} * n)::bigint else dst end as dst from l) select distinct least(src, dst) as src, greatest(src, dst) as dst, 1.0::double as w from m where src <> dst")(lambda s, d: generators.watts_strogatz(s, _n(s, d), 3, 0.1, 4).edges)
query("gen_pairwise", f"select a.p_partkey as src, b.p_partkey as dst from part a join part b on a.p_partkey < b.p_partkey where {uniform_sql(9, 'a.p_partkey', 'b.p_partkey')} < 0.002")(lambda s, d: generators.pairwise(s, 0, 0.002, 9, fx.parts(s, d)))
query("gen_rmat", f"with i as (select i from range(8 << 8) t(i)), q as (select i, {', '.join(f'{uniform_sql(f"rmat2:{k}", "i")} as u{k}' for k in range(8))} from i), x as (select {' + '.join(f'(u{k} >= 0.76)::bigint * {1 << (7 - k)}' for k in range(8))} as a, {' + '.join(f'(u{k} >= 0.57 and u{k} < 0.76 or u{k} >= 0.95)::bigint * {1 << (7 - k)}' for k in range(8))} as b from q) select least(a, b) as src, greatest(a, b) as dst, count(*)::double as w from x group by 1, 2")(lambda s, d: generators.rmat(s, 8, 8, 0.57, 0.19, 0.19, 0.05, 2).edges)
query("gen_erdos_renyi")(lambda s, d: generators.erdos_renyi(s, _n(s, d), 0.004, 1).edges)
query("gen_chung_lu")(lambda s, d: generators.chung_lu(s, pp2(s, d).degrees().select("id", F.col("deg").cast("double").alias("wt")), 1).edges)
query("gen_stochastic_block")(lambda s, d: generators.clustered(s, _n(s, d), 4, 0.02, 0.001)[0].edges)
query("gen_barabasi_albert")(lambda s, d: generators.barabasi_albert(s, _n(s, d), 3).edges)
query("gen_dorogovtsev_mendes")(lambda s, d: generators.dorogovtsev_mendes(s, _n(s, d)).edges)
query("gen_havel_hakimi")(lambda s, d: generators.havel_hakimi(s, [4] * 200 + [2] * 100).edges)
query("gen_edge_switching")(lambda s, d: generators.edge_switching(pp2(s, d), 2).edges)
query("gen_lfr")(lambda s, d: generators.lfr(s, _n(s, d), 5, 50, -2.0, 20, 60, 0.2)[0].edges)
query("gen_pub_web")(lambda s, d: generators.pub_web(s, _n(s, d), 20, 0.05, 12)[0].edges)
query("gen_powerlaw_degrees")(lambda s, d: generators.powerlaw_degrees(s, _n(s, d), 2, 50, -2.5))
query("erdos_gallai", sql("pp2", ", o as (select deg, row_number() over (order by deg desc, id) as k, sum(deg) over (order by deg desc, id) as s from deg) select bool_and(ok) and (select sum(deg) % 2 = 0 from deg) as realizable from (select a.k, any_value(a.s) <= a.k * (a.k - 1) + coalesce(sum(least(b.deg, a.k)), 0) as ok from o a left join o b on b.k > a.k group by a.k)"))(lambda s, d: generators.realizable(pp2(s, d).degrees().select("id", "deg")))

# -- the hyperbolic core
_ALPHA, _R = 1.0, 11.0
_HP = f"pt as (select vec_id as id, {uniform_sql('0:1', 'vec_id')} * {2 * math.pi!r} as phi, acosh(1 + {uniform_sql('0:2', 'vec_id')} * {math.cosh(_ALPHA * _R) - 1!r}) / {_ALPHA} as r from embeddings), pc as (select id, phi, r, cosh(r) as c, sinh(r) as s, cos(phi) as px, sin(phi) as py from pt), he as (select a.id as src, b.id as dst from pc a join pc b on (b.r, b.phi, b.id) < (a.r, a.phi, a.id) where a.c * b.c - a.s * b.s * (a.px * b.px + a.py * b.py) < {math.cosh(_R)!r})"


def _points(s, d):
    return hyperbolic.place(fx.table(s, d, "embeddings").select(F.col("vec_id").alias("id")), _ALPHA, _R)


query("hyper_points", f"with {_HP} select id, round(phi, 6) as phi, round(r, 6) as r from pt")(lambda s, d: _round(_points(s, d), "phi", "r"))
query("hyper_edges", f"with {_HP} select src, dst from he")(lambda s, d: hyperbolic.edges(_points(s, d), _R))
query("hyper_degree_histogram", f"with {_HP}, dg as (select id, count(src) as deg from pt left join he on src = id or dst = id group by id) select deg, count(*) as nodes from dg group by deg")(lambda s, d: stats.degree_distribution(Graph.from_edges(hyperbolic.edges(p := _points(s, d), _R), p.select("id"))))
query("hyper_band_stats", f"with {_HP} select case when r < 5.5 then 0 else floor((r - 5.5) / (5.5 / 6)) + 1 end::bigint as ring, count(*) as points from pt group by 1")(lambda s, d: _points(s, d).groupBy(F.when(F.col("r") < _R / 2, 0).otherwise(F.floor((F.col("r") - _R / 2) / (_R / 2 / 6)) + 1).cast("long").alias("ring")).agg(F.count(F.lit(1)).alias("points")))
query("hyper_warm_edges")(lambda s, d: hyperbolic.warm_edges(_points(s, d), _R, 0.5))
query("hyper_dynamic")(lambda s, d: hyperbolic.edge_changes(hyperbolic.edges(p := _points(s, d), _R), hyperbolic.edges(hyperbolic.moved(p, _R, _ALPHA, 1), _R)))

# -- files: written to the shared folder, read back
def _place(s) -> str:
    return f"{shared_dir(s).rstrip('/')}/files-{uuid.uuid4().hex}"


def _again(format: str, **options):
    """Edges of the graph after a way through a file."""

    def run(s, d):
        g = pp2(s, d)
        write_graph(g, path := _place(s), format, **options)
        return read_graph(s, path, format).edges

    return run


_FILE = sql("pp2", " select src, dst, w from e")
for _name, _options in (("edgelist", {"weights": True}), ("metis", {"weights": True}), ("gml", {}), ("graphml", {}), ("gexf", {})):
    query(f"io_{_name}", _FILE)(_again(_name, **_options))
query("io_convert", _FILE)(lambda s, d: (write_graph(pp2(s, d), a := _place(s), "gml"), convert(s, a, "gml", b := _place(s), "graphml"), read_graphs(s, {"b": b}, "graphml")["b"].edges)[-1])
query("io_metis_nodes", "select p_partkey as id from part")(lambda s, d: (write_graph(pp2(s, d), path := _place(s), "metis"), read_graph(s, path, "metis").nodes)[1])
query("io_graph_tool", sql("pp2", " select src, dst from e"))(lambda s, d: (write_graph(pp2(s, d), f"{(path := _place(s))}/g.gt", "gt"), read_graph(s, path, "gt").edges.select("src", "dst"))[1])
query("io_snap_read", sql("pp2", ", l as (select src, dst, row_number() over (order by src, dst) as line from e), f as (select id, row_number() over (order by min(o)) - 1 as k from (select src as id, 2 * line as o from l union all select dst, 2 * line + 1 from l) group by id) select least(a.k, b.k) as src, greatest(a.k, b.k) as dst from e join f a on a.id = src join f b on b.id = dst"))(lambda s, d: (write_graph(pp2(s, d), path := _place(s), "edgelist"), read_graph(s, path, "snap").edges.select("src", "dst"))[1])
query("io_snap_write", sql("pp2", " select 'p ' || (select count(*) from nodes) || ' ' || count(*) || ' u u 0' as value from e union all select 'a ' || (src + 1) || ' ' || (dst + 1) from e"))(lambda s, d: (write_graph(pp2(s, d), path := _place(s), "snap"), s.read.text(path))[1])
query("io_dot", sql("pp2", " select '  ' || src || ' -- ' || dst || ';' as value from e union all select unnest(['graph G {', '}'])"))(lambda s, d: (write_graph(pp2(s, d), path := _place(s), "dot"), s.read.text(path))[1])
query("io_dot_partition", sql("pp2", """ select '  "' || src || '" -- "' || dst || '";' as value from e union all select '  "' || id || '" [style' from br"""))(lambda s, d: (writers.dot_partition(pp2(s, d), fx.brands(s, d), path := _place(s)), s.read.text(path).where("value like '  %'").select(F.split("value", "=").getItem(0).alias("value")))[1])
query("io_partition", "select p_partkey as id, p_size::bigint as subset from part")(lambda s, d: (writers.partition(fx.sizes(s, d), path := _place(s)), readers.partition(s, path))[1])
query("io_edge_list_partition", sql("pp2", " select src as id, max(dst) as subset from e group by src"))(lambda s, d: (writers.edge_list(Graph.from_edges(pp2(s, d).edges.groupBy("src").agg(F.max("dst").alias("dst"))), path := _place(s)), readers.edge_list_partition(s, path))[1])
query("io_cover", "select p_partkey as id, dense_rank() over (order by p_size) - 1 as subset from part")(lambda s, d: (writers.cover(fx.sizes(s, d), path := _place(s)), readers.cover(s, path))[1])
query("io_edge_list_cover", sql("pp2", " select src as id, dst as subset from bo"))(lambda s, d: (pp2(s, d).both().groupBy("src").agg(F.concat_ws(" ", F.collect_list(F.col("dst").cast("string"))).alias("t")).select(F.concat_ws(" ", "src", "t").alias("value")).write.text(path := _place(s)), readers.edge_list_cover(s, path))[1])
query("io_matrix_market", sql("pp2", " select src as i, src as j, sum(w) as v from bo group by 1 union all select src, dst, -w from bo"))(lambda s, d: (writers.matrix_market(algebra.laplacian(pp2(s, d)), path := _place(s)), readers.matrix_market(s, path))[1])
query("io_konect", sql("pp2", " select src - 1 as src, dst - 1 as dst, 1.0::double as w from e"))(lambda s, d: (pp2(s, d).edges.select(F.concat_ws(" ", "src", "dst").alias("value"), F.lit(1).alias("z")).union(s.createDataFrame([("% sym unweighted", 0)], "value string, z int")).orderBy("z").select("value").write.text(path := _place(s)), read_graph(s, path, "konect").edges)[1])
query("io_events", sql("visits", ", n as (select type, u, v, row_number() over (order by seq) + 1 as seq from ev) select seq, type, u, v from n"))(lambda s, d: (writers.events(fx.visits(s, d), path := _place(s)), readers.events(s, path).select("seq", "type", "u", "v"))[1])
query("io_raster", "select p_size::bigint - 1 as col, sum(p_partkey % 3)::bigint as points from part group by 1 having sum(p_partkey % 3) > 0")(lambda s, d: _rastered(s, d))


def _rastered(s, d):
    """A raster of one row, a cell for each size, and how many points each cell got."""
    c = fx.table(s, d, "part").groupBy("p_size").agg(F.sum(F.col("p_partkey") % 3).alias("n"))
    width = c.agg(F.max("p_size")).first()[0] or 1  # no parts: one empty cell
    row = s.range(1, width + 1).join(c, F.col("id") == F.col("p_size"), "left").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("n", F.lit(0)).cast("string").alias("n")))), lambda x: x["n"]), " ").alias("value"))
    row.write.text(path := _place(s))
    return readers.raster(s, path).groupBy(F.floor(F.col("x") * width).alias("col")).agg(F.count(F.lit(1)).alias("points"))


# -- dynamic graphs
query("dyn_event_fold", sql("visits", ", l as (select a as u, b as v, arg_max(type, seq) as type from ev group by 1, 2) select u, v, 1.0::double as w from l where type = 'EDGE_ADDITION'"))(lambda s, d: dynamic.fold_edges(fx.visits(s, d)))
query("dyn_size_timeline", sql("visits", ", c as (select step, (type = 'EDGE_ADDITION')::int - coalesce(lag((type = 'EDGE_ADDITION')::int) over (partition by a, b order by seq), 0) as d from ev) select step, (sum(sum(d)) over (order by step))::bigint as m from c group by step"))(lambda s, d: dynamic.size_timeline(fx.visits(s, d)))
query("dyn_difference", sql("pp2", " select 'EDGE_REMOVAL' as type, src as u, dst as v, null::double as w from e where w < 3"))(lambda s, d: dynamic.difference(pp2(s, d), fx.co_orders(s, d, 3)))
query("dyn_path_events", f"select step * 3 + o as seq, step, type, case when type = 'NODE_ADDITION' then step when type = 'EDGE_ADDITION' then step - 1 end as u, case when type = 'EDGE_ADDITION' then step end as v, 1.0::double as w from (select unnest(range({_N})) as step), (values (0, 'NODE_ADDITION'), (1, 'EDGE_ADDITION'), (2, 'TIME_STEP')) t(o, type) where step > 0 or o <> 1")(lambda s, d: dynamic.path_events(s, _n(s, d)))
query("dyn_seir")(lambda s, d: dynamic.seir(g := pp2(s, d), _first(g), 12))
query("dyn_state_stream", "select user_id as u, event_id as v, event_type <> 'error' as \"on\" from events")(lambda s, d: _stream_fold(s, d))
query("stream_daily_counts", "select time_bucket(interval '1 day', ts) as opened, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2")(lambda s, d: _stream_daily(s, d))


def _stream_fold(s, d):
    from graphloom.streaming import fold

    e = fold.read_events(s, d)
    return fold.fold_stream(e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("u"), F.col("event_id").alias("v"), (F.col("event_type") != "error").alias("on")))


def _stream_daily(s, d):
    from graphloom.streaming import fold

    out = fold.windowed(fx.table(s, d, "events"))
    return out.select(F.col("opened").cast("timestamp_ntz").alias("opened"), "event_type", "events", F.round("total", 4).alias("total"))


# -- algebra
query("alg_matvec", sql("pp2", " select src as i, sum(w * dst)::double as v from bo group by 1"))(lambda s, d: algebra.matvec(algebra.adjacency(g := pp2(s, d)), g.nodes.select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))))
query("alg_matmul", sql("pp2", " select a.src as i, b.dst as j, sum(a.w * b.w) as v from bo a join bo b on a.dst = b.src group by 1, 2"))(lambda s, d: algebra.matmul(a := algebra.adjacency(pp2(s, d)), a))
query("alg_laplacian", sql("pp2", " select src as i, src as j, sum(w) as v from bo group by 1 union all select src, dst, -w from bo"))(lambda s, d: algebra.laplacian(pp2(s, d)))
query("alg_normalized_laplacian", sql("pp2", " select id as i, id as j, 1.0 as v from deg where deg > 0 union all select src, dst, round(-w / sqrt(a.wdeg * b.wdeg), 6) from bo join deg a on a.id = src join deg b on b.id = dst"))(lambda s, d: _round(algebra.normalized_laplacian(pp2(s, d)), "v"))
query("alg_incidence", sql("pp2", ", x as (select src, dst, w, row_number() over (order by src, dst) - 1 as j from e) select src as i, j::bigint as j, round(sqrt(w), 6) as v from x union all select dst, j, round(-sqrt(w), 6) from x"))(lambda s, d: _round(algebra.incidence(pp2(s, d)), "v"))
query("alg_transpose_sum", sql("seq", " select i, j, sum(v) as v from (select src as i, dst as j, w as v from e union all select dst, src, w from e) group by 1, 2"))(lambda s, d: algebra.add(a := algebra.adjacency(fx.sequences(s, d)), algebra.transpose(a)))
query("alg_is_laplacian", "select true as laplacian")(lambda s, d: algebra.is_laplacian(algebra.laplacian(pp2(s, d))))
def _solved(s, d):
    """(L + I) x = b for the b of a known solution."""
    g = pp2(s, d)
    m = algebra.add(algebra.laplacian(g), g.nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")))
    known = g.nodes.select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("v"))
    return algebra.conjugate_gradient(m, algebra.matvec(m, known))


query("alg_conjugate_gradient", "select p_partkey as i, (p_partkey % 7)::double as v from part")(lambda s, d: _round(_solved(s, d), "v", by=4))
query("alg_pagerank_matrix", sql("pp2", " select dst as i, src as j, round(0.85 * w / wdeg, 9) as v from bo join deg on deg.id = src"))(lambda s, d: _round(algebra.pagerank_matrix(pp2(s, d)), "v", by=9))

# -- profiles
query("prof_stats", sql("pp", ", q as (select deg as score from deg) select count(*) as n, min(score)::double as lowest, max(score)::double as highest, round(avg(score), 6) as mean, quantile_cont(score, 0.25)::double as q1, quantile_cont(score, 0.5)::double as median, quantile_cont(score, 0.75)::double as q3, round(stddev_samp(score), 6) as deviation from q"))(lambda s, d: _round(stats.describe(centrality.degree(pp(s, d))), "mean", "deviation").select("n", "lowest", "highest", "mean", "q1", "median", "q3", "deviation"))
query("prof_pearson", sql("pp", f"{_LCC} select round(corr(deg, lcc), 6) as pearson, round(covar_samp(deg, lcc), 6) as covariance from lc"))(lambda s, d: _round(stats.pearson(centrality.degree(g := ppc(s, d)), tri.local_clustering(g).withColumnRenamed("lcc", "score")), "pearson", "covariance"))
query("prof_spearman", sql("pp", ", r as (select rank() over (order by deg) + (count(*) over (partition by deg) - 1) / 2.0 as x, rank() over (order by wdeg) + (count(*) over (partition by wdeg) - 1) / 2.0 as y from deg) select round(corr(x, y), 6) as spearman from r"))(lambda s, d: _round(stats.spearman(centrality.degree(g := ppc(s, d)), g.degrees().select("id", F.col("wdeg").alias("score"))), "spearman"))
query("prof_degree_distribution", sql("pp", " select deg::bigint as deg, count(*) as nodes from deg group by 1"))(lambda s, d: stats.degree_distribution(pp(s, d)))
query("prof_clustering_per_degree", sql("pp", f"{_LCC} select deg::bigint as deg, round(avg(lcc), 6) as mean_lcc from lc group by 1"))(lambda s, d: _round(stats.clustering_per_degree(ppc(s, d)), "mean_lcc"))
query("prof_overview")(lambda s, d: stats.overview(pp2(s, d)))
query("prof_bins", sql("pp", " select least(floor((deg - a) / (b - a)::double * 20), 19)::bigint as bin, count(*) as count from deg, (select min(deg) as a, max(deg) as b from deg) group by 1"))(lambda s, d: stats.bins(centrality.degree(pp(s, d))))


# -- properties that drawn results must have
def _maximal(g: Graph, chosen: DataFrame) -> DataFrame:
    """One row: whether chosen (src, dst) are a matching of g's edges that no edge could join."""
    used = chosen.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    free = g.edges.where("src <> dst").join(used.withColumnRenamed("id", "src"), "src", "left_anti").join(used.withColumnRenamed("id", "dst"), "dst", "left_anti")
    foreign = chosen.join(g.edges, ["src", "dst"], "left_anti")
    return matching.is_matching(chosen).join(free.agg((F.count(F.lit(1)) == 0).alias("maximal"))).join(foreign.agg((F.count(F.lit(1)) == 0).alias("edges_of_graph")))


def _independent(g: Graph, chosen: DataFrame) -> DataFrame:
    inside = g.subgraph(chosen.select("id")).edges.where("src <> dst").agg((F.count(F.lit(1)) == 0).alias("independent"))
    near = g.both().join(chosen.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).union(chosen.select("id")).distinct()
    return inside.join(g.nodes.join(near, "id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("maximal")))


def _spanning(g: Graph, forest: DataFrame) -> DataFrame:
    """One row: the forest's edges, and the components that they leave."""
    f = Graph(g.nodes, forest.select("src", "dst", "w")).cut()
    return f.edges.agg(F.count(F.lit(1)).alias("edges")).join(components.component_sizes(f).agg(F.count(F.lit(1)).alias("components")))


query("matching_local_max_check", "select true as proper, true as maximal, true as edges_of_graph")(lambda s, d: _maximal(g := pp2(s, d), matching.local_max(g)))
query("independent_set_check", "select true as independent, true as maximal")(lambda s, d: _independent(g := pp2(s, d), matching.luby(g)))
_FOREST = sql("pp2", f"{_CC} select count(*) - count(distinct component) as edges, count(distinct component) as components from cc", True)
query("random_spanning_forest_check", _FOREST)(lambda s, d: _spanning(g := pp2(s, d), components.random_forest(g, 1)))
query("max_spanning_forest_check", _FOREST)(lambda s, d: _spanning(g := pp2(s, d), components.maximum_forest(g)))
query("gen_edge_switching_degrees", sql("pp2", " select id, deg::bigint as deg from deg"))(lambda s, d: generators.edge_switching(pp2(s, d), 2).degrees().select("id", "deg"))
query("gen_havel_hakimi_degrees", "select i as id, case when i < 200 then 4 else 2 end::bigint as deg from range(300) t(i)")(lambda s, d: generators.havel_hakimi(s, [4] * 200 + [2] * 100).degrees().select("id", "deg"))

# -- further forms of operators above
query("bfs_sample", sql("pp2", f"{_BFS}, k as (select id from dist order by dist, id limit 200) select e.src, e.dst, e.w from e join k a on a.id = src join k b on b.id = dst", True))(lambda s, d: (lambda g: traversal.bfs_sample(g, g.edges.agg(F.coalesce(F.min("src"), F.lit(-1))).first()[0], 200).edges)(pp2(s, d)))
query("dyn_growth_events", sql("pp2", ", v as (select id as step, 0 as o, 'NODE_ADDITION' as type, id as u, null::bigint as v, null::double as w from nodes union all select dst, 1, 'EDGE_ADDITION', src, dst, w from e) select step * 16777216 + row_number() over (partition by step order by o, u) as seq, step, type, u, v, w from v"))(lambda s, d: dynamic.growth_events(pp2(s, d)))
query("sparsify_simmelian_parametric", f"select src, dst from ({ORACLES['sparsify_simmelian_overlap']}) where score >= 2")(lambda s, d: sparsify.simmelian_parametric(ppc(s, d), 10, 2).edges.select("src", "dst"))
query("sparsify_jaccard", f"select src, dst from ({ORACLES['edge_jaccard']}) where score <= 0.9500005")(lambda s, d: sparsify.jaccard_sparsifier(ppc(s, d), 0.9500005).edges.select("src", "dst"))
query("sparsify_local_similarity_at", f"select src, dst from ({ORACLES['sparsify_local_similarity']}) where score >= 0.3000005")(lambda s, d: sparsify.local_similarity_sparsifier(ppc(s, d), 0.3000005).edges.select("src", "dst"))
query("sparsify_local_degree_at", f"select src, dst from ({ORACLES['sparsify_local_degree']}) where score >= 0.3000005")(lambda s, d: sparsify.local_degree_sparsifier(ppc(s, d), 0.3000005).edges.select("src", "dst"))
_SP = ", e3 as (select src, dst from e where w >= 3), b3 as (select src, dst from e3 union all select dst, src from e3), r(s, id, d) as (select id, id, 0 from nodes union select r.s, b3.dst, r.d + 1 from r join b3 on b3.src = r.id where r.d < 30), ap as materialized (select s, id, min(d) as d from r group by 1, 2)"
_BTW = f"{_SP}, pc(s, id, d, p) as (select id, id, 0, 1.0::double from nodes union all select c.s, b3.dst, c.d + 1, sum(c.p) from pc c join b3 on b3.src = c.id join ap on ap.s = c.s and ap.id = b3.dst and ap.d = c.d + 1 group by 1, 2, 3)"


def pp3(s, d):
    return fx.co_orders(s, d, 3).cut()


query("apsp", sql("pp2", f"{_SP} select s as source, id, d::double as dist from ap", True))(lambda s, d: traversal.apsp(pp3(s, d).unweighted()).select("source", "id", F.col("dist").cast("double").alias("dist")))
query("betweenness", sql("pp2", f"{_BTW} select n.id, round(coalesce(sum(a.p * b.p / c.p), 0), 6) as score from nodes n left join (pc a join pc b on b.s = a.id and b.id <> a.id join pc c on c.s = a.s and c.id = b.id and c.d = a.d + b.d) on n.id = a.id and a.id <> a.s group by n.id", True))(lambda s, d: _round(centrality.betweenness(pp3(s, d))[0], "score"))
query("edge_betweenness", sql("pp2", f"{_BTW}, f as (select least(x.src, x.dst) as src, greatest(x.src, x.dst) as dst, sum(a.p * b.p / c.p) as f from pc a join b3 x on x.src = a.id join pc b on b.s = x.dst join pc c on c.s = a.s and c.id = b.id and c.d = a.d + 1 + b.d group by 1, 2) select e3.src, e3.dst, round(coalesce(f, 0), 6) as score from e3 left join f on f.src = e3.src and f.dst = e3.dst", True))(lambda s, d: _round(centrality.betweenness(pp3(s, d))[1], "score"))


# -- SQL of queries registered above without any
def oracle(name: str, text: str) -> None:
    ORACLES[name] = text


_LEVELS = "select distinct w as t from e"
_BY_LEVEL = ", th as ({levels}), r(t, id, c) as (select t, id, id from th, nodes union select r.t, bo.dst, r.c from r join bo on bo.src = r.id and bo.w {than} r.t and r.c < bo.dst), cc as (select t, id, min(c) as c from r group by 1, 2)"
oracle("bfs_path_counts", sql("pp2", f"{_BFS}, pc(id, d, p) as (select s, 0::bigint, 1.0::double from {_SRC} union all select bo.dst, r.d + 1, sum(r.p) from pc r join bo on bo.src = r.id join dist on dist.id = bo.dst and dist.dist = r.d + 1 group by 1, 2) select id, p as paths from pc", True))
oracle("dyn_bfs_insertions", sql("pp2", f"{_BFS} select id, dist::double as dist from dist", True))
oracle("max_spanning_forest", sql("pp2", f"{_BY_LEVEL.format(levels=_LEVELS, than='>=')}, k as (select t, count(*) - count(distinct c) as k from cc group by t) select sum(t * (k - p))::double as weight, max(k)::bigint as edges from (select t, k, coalesce(lag(k) over (order by t desc), 0) as p from k)", True))
oracle("union_max_forest", sql("pp2", f"{_BY_LEVEL.format(levels=_LEVELS, than='>')} select e.src, e.dst, e.w from e join cc a on a.t = e.w and a.id = e.src join cc b on b.t = e.w and b.id = e.dst where a.c <> b.c", True))
oracle("bfs_forest", sql("pp2", f"{_CC}, q(id, d) as (select distinct component, 0 from cc union select bo.dst, q.d + 1 from q join bo on bo.src = q.id where q.d < 40), ds as (select id, min(d) as d from q group by id), tr as (select min(bo.src) as p, a.id as c from ds a join bo on bo.dst = a.id join ds b on b.id = bo.src and b.d + 1 = a.d group by a.id) select e.src, e.dst, e.w from tr join e on e.src = least(p, c) and e.dst = greatest(p, c)", True))
oracle("core_numbers", sql("pp", ", x0 as materialized (select id, deg as s from deg)" + "".join(f", x{i + 1} as materialized (select n.id, coalesce(max(least(h.k, h.v)), 0) as s from nodes n left join (select bo.src, p.s as v, row_number() over (partition by bo.src order by p.s desc) as k from bo join x{i} p on p.id = bo.dst) h on h.src = n.id group by n.id)" for i in range(60)) + " select id, s::bigint as core from x60"))
oracle("effective_diameter", sql("pp2", f"{_AP}, si as (select s, count(*) as n from ap group by s), top as (select max(n) as n from si), c as (select s, d, sum(count(*)) over (partition by s order by d) as r from ap join si using (s) join top using (n) group by s, d) select avg(h)::double as effective from (select s, min(d) as h from c, top where r >= ceil(0.9 * n) group by s)", True))
oracle("approx_closeness", sql("pp2", f", pv as (select id as v from nodes order by {uniform_sql('node0', 'id')}, id limit 16), r(s, id, d) as (select v, v, 0 from pv union select r.s, bo.dst, r.d + 1 from r join bo on bo.src = r.id where r.d < 40), ap as (select s, id, min(d) as d from r group by 1, 2) select id, round(count(*) / nullif(sum(d) * (select count(*) from nodes), 0)::double, 9) as score from ap group by id", True))
oracle("lp_same_community", sql("pp2", f"{_P2} select u, v, (a.subset = b.subset)::int::double as score from pr join br a on a.id = u join br b on b.id = v"))
oracle("lp_roc_auc", sql("pp2", f", {_TRAIN}, xy as (select (k - tp) / neg::double as x, arg_max(tp / pos::double, i) as y from cu, to_ group by 1) select round(sum(a), 6) as auc from (select (x - lag(x) over (order by x)) * (y + lag(y) over (order by x)) / 2 as a from xy)"))
oracle("lp_katz", sql("pp2", f"{_P2}, p as (select u, v, case when a.deg <= b.deg then u else v end as s, case when a.deg <= b.deg then v else u end as t from pr join deg a on a.id = u join deg b on b.id = v), h0 as (select distinct s, s as at_, 1 as k from p)" + "".join(f", h{i} as (select h.s, bo.dst as at_, count(*) as k from h{i - 1} h join bo on bo.src = h.at_ group by 1, 2)" for i in range(1, 5)) + " select u, v, round(" + " + ".join(f"coalesce(max(h{i}.k), 0) * {0.005**i!r}" for i in range(1, 5)) + ", 9) as score from p " + " ".join(f"left join h{i} on h{i}.s = p.s and h{i}.at_ = p.t" for i in range(1, 5)) + " group by u, v"))
_PREFIX = ", rn as (select ego, alter, dense_rank() over (partition by ego order by score desc) - 1 as r from si), lr as (select coalesce(a.src, b.src) as src, coalesce(a.dst, b.dst) as dst, a.r as ra, b.r as rb from (select src, dst, alter, r from e join rn on ego = src and alter <> dst) a full join (select src, dst, alter, r from e join rn on ego = dst and alter <> src) b on a.src = b.src and a.dst = b.dst and a.alter = b.alter), ks as (select distinct src, dst, unnest([ra, rb]) as k from lr), jk as (select l.src, l.dst, k, count(*) filter (where ra <= k and rb <= k) / count(*) filter (where ra <= k or rb <= k)::double as j from lr l join ks on ks.src = l.src and ks.dst = l.dst and k is not null group by 1, 2, 3), pj as (select e.src, e.dst, e.w, coalesce(max(j), 0.0) as score from e left join jk on jk.src = e.src and jk.dst = e.dst group by 1, 2, 3)"
oracle("edge_prefix_jaccard", sql("pp2", f"{_SIDE.format(v='w', t='e')}{_PREFIX} select src, dst, round(score, 6) as score from pj"))
oracle("sparsify_simmelian", sql("pp2", f"{_TRI}{_SIDE.format(v='t', t='ts')}{_PREFIX} select src, dst, w from pj where score >= 0.2"))
_QUAD = ", qs as (select e.src, e.dst, e.w, coalesce(q, 0)::double as q from e left join (select e.src, e.dst, count(*) as q from e join bo x on x.src = e.src and x.dst <> e.dst join bo y on y.src = e.dst and y.dst <> e.src join bo z on z.src = x.dst and z.dst = y.dst where x.dst <> y.dst group by 1, 2) k on k.src = e.src and k.dst = e.dst), qd as (select id, sum(q) as s from (select src as id, q from qs union all select dst, q from qs) group by id), qg as (select qs.src, qs.dst, case when q = 0 then 0.0 else q / sqrt(a.s * b.s) end as g from qs join qd a on a.id = qs.src join qd b on b.id = qs.dst)"
oracle("sparsify_quadrilateral", sql("pp2", f"{_QUAD}{_SIDE.format(v='g', t='qg')}{_PREFIX} select src, dst, w from pj where score >= 0.2"))
oracle("sparsify_random_node_edge", sql("pp2", f" select src, dst, case when {uniform_sql('kind0', 'src', 'dst')} < 0.8 then {uniform_sql('edge0', 'src', 'dst')} when {uniform_sql('end0', 'src', 'dst')} < 0.5 then {uniform_sql('node0', 'src')} else {uniform_sql('node0', 'dst')} end as score from e"))
_DISPARITY = ", ew as ({}), es as (select id, sum(x) as s, count(*) as d from (select src as id, x from ew union all select dst, x from ew) group by id) select ew.src, ew.dst, e.w from ew join e on e.src = ew.src and e.dst = ew.dst join es a on a.id = ew.src join es b on b.id = ew.dst where greatest(1 - pow(1 - x / nullif(a.s, 0), a.d - 1), 1 - pow(1 - x / nullif(b.s, 0), b.d - 1)) >= {}"
oracle("sparsify_simmelian_multiscale", sql("pp", _TRI + _DISPARITY.format("select src, dst, t::double as x from ts", "0.8")))
oracle("sparsify_degree_multiscale", sql("pp2", _DISPARITY.format("select e.src, e.dst, greatest(a.deg, b.deg)::double as x from e join deg a on a.id = e.src join deg b on b.id = e.dst", "0.5")))
_LOADS = range(4)
oracle(
    "algebraic_distance",
    sql("pp2", f", x0 as materialized (select id, {', '.join(f'{uniform_sql(f"load0:{i}", "id")} as x{i}' for i in _LOADS)} from nodes)" + "".join(f", x{k + 1} as materialized (select p.id, {', '.join(f'coalesce(0.5 * any_value(p.x{i}) + 0.5 * sum(q.x{i} * w) / sum(w), any_value(p.x{i})) as x{i}' for i in _LOADS)} from x{k} p left join bo on bo.dst = p.id left join x{k} q on q.id = bo.src group by p.id)" for k in range(8)) + f", lo as (select {', '.join(f'min(x{i}) as l{i}, max(x{i}) - min(x{i}) as g{i}' for i in _LOADS)} from x8) select src, dst, round(greatest({', '.join(f'abs(a.x{i} - b.x{i}) / g{i}' for i in _LOADS)}), 6) as score from e join x8 a on a.id = src join x8 b on b.id = dst, lo"),
)
oracle(
    "prof_overview",
    sql("pp2", f"{_LCC}{_CC}, cs as (select component, count(*) as size from cc group by 1), nn as (select count(*) as n from nodes) select n, (select count(*) from e) as m, (select count(*) from e where src = dst) as loops, (select sum(w) from e) as weight, round((select count(*) from e) / (n * (n - 1) / 2.0), 6) as density, (select min(deg) from deg)::bigint as min_deg, (select max(deg) from deg)::bigint as max_deg, round((select avg(deg) from deg), 6) as mean_deg, (select count(*) from deg where deg = 0) as isolated, (select count(*) from cs) as components, (select max(size) from cs)::bigint as largest, round((select sum(2.0 * t) / sum(deg * (deg - 1)) from lc), 6) as closed, round((select avg(lcc) filter (where deg > 1) from lc), 6) as mean_local from nn", True),
)
QUERIES["prof_overview"] = lambda s, d: _round(stats.overview(pp2(s, d)), "density", "mean_deg", "closed", "mean_local")
_SEIR = "select p.id, case when state = 'S' and hit then 'E' when state = 'E' and {t} + 1 - since >= 2 then 'I' when state = 'I' and {t} + 1 - since >= 7 then 'R' else state end as state, case when (state = 'S' and hit) or (state = 'E' and {t} + 1 - since >= 2) or (state = 'I' and {t} + 1 - since >= 7) then {t} + 1 else since end as since from (select x.*, c.dst is not null as hit from x{t} x left join (select distinct bo.dst from x{t} y join bo on bo.src = y.id where y.state = 'I' and {u} < 0.5) c on c.dst = x.id) p"
oracle("dyn_seir", sql("pp2", f", x0 as materialized (select id, case when id = (select min(src) from e) then 'I' else 'S' end as state, 0 as since from nodes)" + "".join(f", x{t + 1} as materialized ({_SEIR.format(t=t, u=uniform_sql(f'seir0:{t}', 'bo.src', 'bo.dst'))})" for t in range(12)) + " select step, state, nodes from (" + " union all ".join(f"select {t} as step, state, count(*) as nodes from x{t} group by state" for t in range(13)) + ")"))
oracle("hyper_dynamic", f"with {_HP}, mv as (select id, phi + ({uniform_sql('turn0:1', 'id')} - 0.5) * 0.1 as phi, abs((cosh({_ALPHA} * r) - 1) / {math.cosh(_ALPHA * _R) - 1!r} + ({uniform_sql('drift0:1', 'id')} - 0.5) * 0.05) as u from pt), mt as (select id, phi - floor(phi / {2 * math.pi!r}) * {2 * math.pi!r} as phi, acosh(1 + (case when u > 1 then 2 - u else u end) * {math.cosh(_ALPHA * _R) - 1!r}) / {_ALPHA} as r from mv), mc as (select id, phi, r, cosh(r) as c, sinh(r) as s, cos(phi) as px, sin(phi) as py from mt), h1 as (select least(src, dst) as u, greatest(src, dst) as v from he), h2 as (select a.id as u, b.id as v from mc a join mc b on a.id < b.id where a.c * b.c - a.s * b.s * (a.px * b.px + a.py * b.py) < {math.cosh(_R)!r}) select 'EDGE_REMOVAL' as type, u, v from h1 where not exists (select 1 from h2 where h2.u = h1.u and h2.v = h1.v) union all select 'EDGE_ADDITION', u, v from h2 where not exists (select 1 from h1 where h2.u = h1.u and h2.v = h1.v)")
oracle("gen_barabasi_albert", f"with recursive x as materialized (select i as e, i // 3 as src, floor({uniform_sql('ba0', 'i')} * (2 * i + 1))::bigint as p from (select unnest(range({_N} * 3)) as i)), r(e, src, p) as (select * from x union all select r.e, r.src, x.p from r join x on r.p % 2 = 1 and x.e = (r.p - 1) // 2) select distinct least(src, p // 6) as src, greatest(src, p // 6) as dst, 1.0::double as w from r where p % 2 = 0 and src <> p // 6")
oracle("gen_dorogovtsev_mendes", f"with recursive dr as materialized (select u, floor({uniform_sql('dm0', 'u')} * (2 * u - 3))::bigint as r from (select unnest(range(3, {_N})) as u)), x as materialized (select 2 * u - 3 as e, 1 as k, u, r as p from dr union all select 2 * u - 2, 2, u, r from dr), b as (select * from (values (0, 0, 1), (1, 0, 2), (2, 1, 2)) t(e, a, b)), w(u, k, p) as (select u, k, p from x union all select w.u, x.k, x.p from w join x on w.k = 1 and x.e = w.p) select b.a as src, b.b as dst, 1.0::double as w from b union all select case when w.k = 1 then b.a else coalesce(b.b, (w.p + 3) // 2) end, u, 1.0 from w left join b on b.e = w.p where w.k = 2 or b.e is not null")
oracle("gen_powerlaw_degrees", f"select i as id, 2 + len(list_filter({generators.powerlaw_shares(2, 50, -2.5)!r}, lambda c: c < {uniform_sql('deg0', 'i')}))::bigint as deg from (select unnest(range({_N})) as i)")

from graphloom.plans import more  # noqa: E402, F401 - registers its queries
