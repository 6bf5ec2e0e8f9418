"""Queries of result tables and identifiers on the driver's tables, and their SQL; they join those of ``catalogue``.

Orders stand for speciation or duplication nodes, their lines for genes, suppliers for species.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeforge.operators import alignments, clustering, genetrees, identifiers, profiles, results, similarity, species_trees, trees
from cladeforge.plans import inputs
from cladeforge.plans.catalogue import ORACLE, QUERIES, TREE, _heap, query  # noqa: F401
from cladeforge.sources import sinks

SIDES = """sides as (select distinct l_orderkey % 97 as og, l_orderkey as node, (l_linenumber % 2)::integer as side, l_suppkey % 5 as sp, l_partkey as gene, l_partkey % 13 = 0 as suspect from lineitem)"""
ROWS = """cells as (select og, node, side, sp, string_agg(gene::varchar, ', ' order by gene::varchar) as genes, count(*) as n from sides group by og, node, side, sp),
  pairs as (select a.og, a.node, a.sp as sp_a, a.genes as genes_a, a.n as n_a, b.sp as sp_b, b.genes as genes_b, b.n as n_b from cells a join cells b on a.og = b.og and a.node = b.node and a.side <> b.side and a.sp <> b.sp)"""
TOTALS = """totals as (select sp_a, sp_b, sum(n_a)::bigint as total, coalesce(sum(n_a) filter (n_a = 1 and n_b = 1), 0)::bigint as one_one, coalesce(sum(n_a) filter (n_a = 1 and n_b > 1), 0)::bigint as one_many,
  coalesce(sum(n_a) filter (n_a > 1 and n_b = 1), 0)::bigint as many_one, coalesce(sum(n_a) filter (n_a > 1 and n_b > 1), 0)::bigint as many_many from pairs group by sp_a, sp_b)"""


def _sides(spark, sf_dir):
    li = inputs.table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 97).alias("og"), F.col("l_orderkey").alias("node"), (F.col("l_linenumber") % 2).cast("int").alias("side"), (F.col("l_suppkey") % 5).alias("sp"), F.col("l_partkey").alias("gene"), (F.col("l_partkey") % 13 == 0).alias("suspect")).distinct()


@query(f"with {SIDES}, {ROWS} select * from pairs")
def ortholog_rows(spark, sf_dir):
    return results.ortholog_rows(_sides(spark, sf_dir))


@query(f"with {SIDES}, {ROWS}, {TOTALS} select * from totals")
def ortholog_totals(spark, sf_dir):
    return results.multiplicity_totals(results.ortholog_rows(_sides(spark, sf_dir)))


@query(f'with {SIDES}, {ROWS}, {TOTALS} select s.sp_a, ' + ", ".join(f'coalesce(sum(many_many) filter (sp_b = {k}), 0)::bigint as "{k}"' for k in range(5)) + " from (select unnest(range(5)) as sp_a) s left join totals t on t.sp_a = s.sp_a group by s.sp_a")
def ortholog_matrix(spark, sf_dir):
    return results.square(results.multiplicity_totals(results.ortholog_rows(_sides(spark, sf_dir))), "many_many", list(range(5)))


@query(f"with {SIDES} select a.og, a.node, a.gene as a, b.gene as b from sides a join sides b on a.og = b.og and a.node = b.node and a.side = 0 and b.side = 1 and a.sp <> b.sp")
def ortholog_gene_pairs(spark, sf_dir):
    return results.gene_pairs(_sides(spark, sf_dir))


@query(f"""with {SIDES}, odd as (select og, node, side, sp, string_agg(gene::varchar, ', ' order by gene::varchar) as genes from sides where suspect group by og, node, side, sp),
  every as (select og, node, side, sp, string_agg(gene::varchar, ', ' order by gene::varchar) as genes from sides group by og, node, side, sp),
  r as (select a.og, a.node, a.sp as sp_a, a.genes as genes_a, b.sp as sp_b, b.genes as genes_b from odd a join every b on a.og = b.og and a.node = b.node and a.side <> b.side and a.sp <> b.sp)
  select * from r union all select og, node, sp_b, genes_b, sp_a, genes_a from r""")  # fmt: skip
def putative_xenologs(spark, sf_dir):
    return results.suspect_rows(_sides(spark, sf_dir))


@query(f"with {SIDES} select distinct sp, gene from sides where suspect")
def misplaced_genes(spark, sf_dir):
    return results.misplaced(_sides(spark, sf_dir))


DUPS = """genes as (select l_orderkey as k, list_sort(coalesce(list(l_partkey::varchar) filter (l_linenumber % 2 = 1), [])) as genes_1, list_sort(coalesce(list(l_partkey::varchar) filter (l_linenumber % 2 = 0), [])) as genes_2,
    list_sort(list(l_partkey::varchar)) as genes from lineitem group by l_orderkey),
  dups as (select o_custkey % 61 as og, case when o_orderkey % 4 = 0 then 's' else 'N' end || (o_orderkey % 7)::varchar as level, o_orderkey as node, (o_orderkey % 11) / 10.0 as support, genes_1, genes_2, genes from orders join genes on k = o_orderkey)"""


def _dups(spark, sf_dir):
    li, o = inputs.table(spark, sf_dir, "lineitem"), inputs.table(spark, sf_dir, "orders")
    part = lambda r: F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == r, F.col("l_partkey").cast("string"))))
    genes = li.groupBy(F.col("l_orderkey").alias("node")).agg(part(1).alias("genes_1"), part(0).alias("genes_2"))
    level = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "s").otherwise("N"), (F.col("o_orderkey") % 7).cast("string"))
    return o.select((F.col("o_custkey") % 61).alias("og"), level.alias("level"), F.col("o_orderkey").alias("node"), ((F.col("o_orderkey") % 11) / 10.0).alias("support")).join(genes, "node")


@query(f"""with {DUPS} select og, level, node, support, case when level like 's%' then 'Terminal' when genes in (select genes from dups where node % 3 = 0) then 'Non-Terminal: STRIDE' else 'Non-Terminal' end as type,
  array_to_string(genes_1, ', ') as genes_1, array_to_string(genes_2, ', ') as genes_2 from dups""")  # fmt: skip
def duplication_rows(spark, sf_dir):
    dups = _dups(spark, sf_dir)
    confirmed = dups.where("node % 3 = 0").select(F.array_sort(F.concat("genes_1", "genes_2")).alias("genes"))
    return results.duplication_rows(dups, confirmed)


@query(f"with {DUPS} select level, count(*) as n, count(*) filter (support >= 0.5) as n_50 from dups group by level")
def duplications_per_level(spark, sf_dir):
    return results.duplications_per_level(_dups(spark, sf_dir))


@query(f"with {DUPS}, d as (select * from dups where level like 'N%') select g.og, count(d.og) as n, count(d.og) filter (support >= 0.5) as n_50 from (select unnest(range((select max(og) + 1 from d))) as og) g left join d on d.og = g.og group by g.og")
def duplications_per_group(spark, sf_dir):
    return results.duplications_per_group(_dups(spark, sf_dir).where("level like 'N%'"))


@query(f"with {DUPS}, r as (select level, og, node from dups where level like 'N%') select level, og, node, level || '.HOG' || lpad((row_number() over (partition by level order by og, node) - 1)::varchar, 7, '0') as hog from r")
def numbered_hogs(spark, sf_dir):
    return results.numbered_hogs(_dups(spark, sf_dir).where("level like 'N%'").select("level", "og", "node"))


SPECIES_TREE = [("N0", None), ("N1", "N0"), ("N2", "N0"), ("N3", "N2"), ("s0", "N1"), ("s1", "N1"), ("s2", "N2"), ("s3", "N3"), ("s4", "N3")]
SMALL = """small as (select l_orderkey as og, 's' || (l_suppkey % 5)::varchar as sp, l_partkey as gene from lineitem group by all),
  sized as (select og, count(*) as n, count(distinct sp) as n_sp, list_sort(list(distinct sp)) as sps from small group by og)"""


def _small(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("og"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("sp"), F.col("l_partkey").alias("gene")).distinct()


@query("with recursive st(node, parent) as (values " + ", ".join(f"('{a}', {repr(b) if b else 'null'})" for a, b in SPECIES_TREE) + f"""), up(node, above, steps) as (select node, node, 0 from st union all select u.node, st.parent, u.steps + 1 from up u join st on st.node = u.above where st.parent is not null),
  depth as (select node, max(steps) as depth from up group by node), {SMALL},
  seen as (select distinct small.og, n_sp, sp from small join sized on small.og = sized.og where n between 2 and 3),
  common as (select og, n_sp, above from seen join up on up.node = sp group by og, n_sp, above having count(*) = n_sp),
  ranked as (select og, n_sp, above, depth, max(depth) over (partition by og) as deepest from common join depth on depth.node = above)
  select og, above as level from ranked where n_sp > 1 or depth < deepest""")  # fmt: skip
def small_group_levels(spark, sf_dir):
    return results.small_group_levels(_small(spark, sf_dir), results.ancestors_of_species(spark.createDataFrame(SPECIES_TREE, "node string, parent string")))


@query(f"""with {SMALL}, r as (select small.*, list_position(sps, sp) as pos, len(sps) as k from small join sized on small.og = sized.og where n between 2 and 3 and n_sp > 1)
  select og, 0 as node, (case when pos > 1 then 1 else 0 end)::integer as side, sp, gene from r union all select og, 1, (case when pos > 2 then 1 else 0 end)::integer, sp, gene from r where k = 3 and pos > 1""")  # fmt: skip
def small_group_sides(spark, sf_dir):
    return results.small_group_sides(_small(spark, sf_dir))


@query("with a as (select distinct l_orderkey % 100 as og, l_partkey as gene from lineitem), b as (select distinct o_custkey as og, o_orderkey as gene from orders) select og, gene from a union all select og + (select max(og) + 1 from a), gene from b")
def merged_groups(spark, sf_dir):
    li, o = inputs.table(spark, sf_dir, "lineitem"), inputs.table(spark, sf_dir, "orders")
    return results.merged_groups(li.select((F.col("l_orderkey") % 100).alias("og"), F.col("l_partkey").alias("gene")).distinct(), o.select(F.col("o_custkey").alias("og"), F.col("o_orderkey").alias("gene")).distinct())


PAIRS = "pairs as (select distinct l_partkey as a, l_orderkey as b from lineitem)"


def _pairs(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_orderkey").alias("b"))


@query(f"with {PAIRS} select distinct x.a, y.a as other from pairs x join pairs y on x.b = y.b")
def coorthologs(spark, sf_dir):
    return results.coorthologs(_pairs(spark, sf_dir))


@query(f"with {PAIRS}, s as (select b, string_agg(a::varchar, ', ' order by a::varchar) as genes_b from pairs group by b) select string_agg(b::varchar, ', ' order by b::varchar) as genes_a, genes_b from s group by genes_b")
def same_orthologs(spark, sf_dir):
    return results.same_orthologs(_pairs(spark, sf_dir).select(F.col("b").alias("a"), F.col("a").alias("b")))


@query(f"with {inputs.SUPPLIER_MEMBERS}, f as (select og from members group by og having count(distinct sp) >= 25) select count(*) as n, count(*) >= 100 as enough from f")
def enough_for_species_tree(spark, sf_dir):
    return results.enough_for_species_tree(inputs.supplier_members(spark, sf_dir), 25)


@query(f"with {SIDES}, t as (select og, string_agg(gene::varchar, ', ' order by gene) filter (sp = 0) as a, string_agg(gene::varchar, ', ' order by gene) filter (sp = 1 and gene % 50 = 0) as b from sides group by og) select og, case when coalesce(a, '') = '' then 0 else len(string_split(a, ', ')) end as a, case when coalesce(b, '') = '' then 0 else len(string_split(b, ', ')) end as b from t")
def counts_from_cells(spark, sf_dir):
    cell = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(F.expr(cond), F.col("gene").cast("string")))), ", ")
    table = _sides(spark, sf_dir).groupBy("og").agg(cell("sp = 0").alias("a"), cell("sp = 1 and gene % 50 = 0").alias("b"))
    return results.counts_from_cells(table, ["a", "b"])


CLADES = {"c1": [0], "c2": [1], "c3": [0, 1], "c4": [2], "c5": [3, 4], "c6": [3]}


@query("with clades(clade, species) as (values " + ", ".join(f"('{c}', {s})" for c, xs in CLADES.items() for s in xs) + """), obs as (select l_orderkey as id, count(*) as n, list(distinct l_suppkey % 5) as sps from lineitem group by l_orderkey),
  size as (select id, n, len(sps) as k from obs), inside as (select clade, id, count(*) as i from (select id, unnest(sps) as species from obs) o join clades using (species) group by clade, id),
  against as (select clade, sum(n) as against from inside join size using (id) where i < k group by clade), every as (select c.clade, coalesce(against, 0)::bigint as against from (select distinct clade from clades) c left join against using (clade))
  select clade, against from every where against = (select min(against) from every)""")  # fmt: skip
def parsimony_roots(spark, sf_dir):
    li = inputs.table(spark, sf_dir, "lineitem")
    observed = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.col("l_suppkey") % 5).alias("species")).select("id", "n", F.explode("species").alias("species"))
    clades = spark.createDataFrame([(c, s) for c, xs in CLADES.items() for s in xs], "clade string, species long")
    return results.parsimony_roots(clades, observed)


SIX = "((A:1,B:1):1,((C:1,D:1):1,(E:1,F:1):1):1);"
#: Gene trees by order key modulo 6 (their genes are numbered by the key), and the clade whose duplication each supports.
SHAPES = {
    0: ("(A|1-%,B|1-%,(((C|1-%,D|1-%),(E|1-%,F|1-%)),((C|2-%,D|2-%),(E|2-%,F|2-%))));", "CDEF"),
    1: ("(A|1-%,B|1-%,(((C|1-%,D|1-%),(E|1-%,F|1-%)),((C|2-%,E|2-%),(D|2-%,F|2-%))));", ""),
    2: ("((A|1-%,A|2-%),B|1-%,C|1-%);", "A"),
    3: ("((C|1-%,D|1-%),(E|1-%,F|1-%),((A|1-%,B|1-%),((C|2-%,D|2-%),(E|2-%,F|2-%))));", "CDEF"),
    4: ("((A|1-%,B|1-%),((((A|2-%,B|2-%),(E|1-%,F|1-%)),((A|3-%,B|3-%),(E|2-%,F|2-%))),(C|1-%,D|1-%)),(C|2-%,D|2-%));", "ABEF"),
    5: ("(A|1-%,B|1-%,(((C|1-%,D|1-%),(E|1-%,F|1-%)),(C|2-%,D|2-%)));", ""),
}


def _shaped_trees(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").where("o_orderkey is not null")
    text = F.coalesce(*(F.when(F.col("o_orderkey") % 6 == k, F.lit(t)) for k, (t, _) in SHAPES.items()))
    return o.select(F.col("o_orderkey").alias("og"), F.replace(text, F.lit("%"), F.col("o_orderkey").cast("string")).alias("newick"))


@query("with shapes(k, clade, n_genes) as (values " + ", ".join(f"({k}, '{c}', {2 * len(c) if len(c) > 1 else 'null'})" for k, (_, c) in SHAPES.items() if c) + ") select o_orderkey as og, clade, n_genes::bigint as n_genes from orders join shapes on k = o_orderkey % 6")
def supported_duplications(spark, sf_dir):
    found = genetrees.supported_duplications(_shaped_trees(spark, sf_dir), SIX)
    return found.select("og", F.array_join("species", "").alias("clade"), F.when(F.col("genes").isNotNull(), F.size("genes")).cast("long").alias("n_genes"))


@query()
def root_probabilities(spark, sf_dir):
    """Probability of each branch of the species tree to hold its root (tests hold the kernel against numeric integrals)."""
    _, _, probable = genetrees.species_tree_root(genetrees.supported_duplications(_shaped_trees(spark, sf_dir), SIX), SIX)
    return spark.createDataFrame([("".join(sorted(r)), round(p, 9)) for r, p in sorted(probable.items(), key=lambda x: sorted(x[0]))], "clade string, probability double")  # a row a branch


# ---- identifiers --------------------------------------------------------------------------------------------------


@query("select n_nationkey::integer as species_id, n_name as species, n_regionkey <> 1 as used from nation")
def species_list(spark, sf_dir):
    n = inputs.table(spark, sf_dir, "nation")
    return identifiers.species_list(n.select(F.concat(F.when(F.col("n_regionkey") == 1, "#").otherwise(""), F.col("n_nationkey").cast("string"), F.lit(": "), "n_name", F.lit("  ")).alias("value")))


OFFSETS = "counts as (select c_nationkey as species_id, count(*) as n from customer group by c_nationkey), used as (select n_nationkey as species_id from nation where n_regionkey <> 1), kept as (select * from counts where species_id in (select species_id from used)), offs as (select species_id, n, (sum(n) over (order by species_id) - n)::bigint as start from kept)"


def _offsets(spark, sf_dir):
    counts = inputs.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("species_id")).agg(F.count(F.lit(1)).alias("n"))
    return identifiers.subset_offsets(counts, inputs.table(spark, sf_dir, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("species_id")))


@query(f"with {OFFSETS} select * from offs")
def subset_offsets(spark, sf_dir):
    return _offsets(spark, sf_dir)


@query(f"with {OFFSETS} select c_custkey as id, species_id, c_custkey - start as seq_idx from customer join offs on c_custkey >= start and c_custkey < start + n")
def pair_ids(spark, sf_dir):
    return identifiers.pair_ids(inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), _offsets(spark, sf_dir))


@query("select p_partkey, replace(replace(p_brand, '.', '_'), ' ', '_') || '_' || p_name as accession from part where p_brand is not null and p_name is not null")
def prefixed_accessions(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").where("p_brand is not null and p_name is not null").select("p_partkey", identifiers.prefixed(F.col("p_brand"), F.col("p_name")).alias("accession"))


@query("select l_partkey, l_suppkey, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_accessions(spark, sf_dir):
    return identifiers.duplicates(inputs.table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("select l_partkey, case when count(distinct l_suppkey) > 1 then 'inf_inf' else min(l_suppkey::varchar) end as l_suppkey from lineitem where l_quantity > 45 group by l_partkey")
def accession_index(spark, sf_dir):
    return identifiers.accession_index(inputs.table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "l_partkey", "l_suppkey")


@query("with w as (select 'gene' as tag, p_brand as id from part union all select 'size', p_size::varchar || ':x' from part) select tag, id, count(*) as n from w group by all")
def header_tags(spark, sf_dir):
    p = inputs.table(spark, sf_dir, "part")
    return identifiers.header_tags(p.select(F.concat(F.lit("p gene:"), "p_brand", F.lit(" word size:"), F.col("p_size").cast("string"), F.lit(":x ")).alias("header")))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'protein ' || p_brand || ' [org]' else case when p_size < 40 then 'XP_' else 'ENSP_' end || p_partkey::varchar || '.1 protein ' || p_brand || ' [org]' end as gene, p_size < 40 as refseq from part")
def isoform_free_headers(spark, sf_dir):
    iso = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("isoform X"), (F.col("p_partkey") % 4).cast("string"), F.lit(" "))).otherwise("")
    head = F.concat(F.when(F.col("p_size") < 40, "XP_").otherwise("ENSP_"), F.col("p_partkey").cast("string"), F.lit(".1 protein "), "p_brand", F.lit(" "), iso, F.lit("[org]"))
    return inputs.table(spark, sf_dir, "part").select("p_partkey", identifiers.isoform_free(head).alias("gene"), identifiers.is_refseq(head).alias("refseq"))


@query("select 'g' || (l_suppkey % 40)::varchar || 'x' || (l_partkey % 300)::varchar as name, 'g' || lpad((l_suppkey % 40)::varchar, 20, '0') || 'x' || lpad((l_partkey % 300)::varchar, 20, '0') as key from lineitem group by all")
def natural_keys(spark, sf_dir):
    name = F.concat(F.lit("g"), (F.col("l_suppkey") % 40).cast("string"), F.lit("x"), (F.col("l_partkey") % 300).cast("string")).alias("name")
    return inputs.table(spark, sf_dir, "lineitem").select(name).distinct().withColumn("key", identifiers.natural_key(F.col("name")))


@query("with i as (select c_nationkey as species_id, c_custkey as seq_idx from customer) select species_id, count(distinct seq_idx) as n, max(seq_idx) as last from i group by species_id having min(seq_idx) <> 0 or max(seq_idx) + 1 <> count(distinct seq_idx)")
def id_gaps(spark, sf_dir):
    return identifiers.gaps(inputs.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("species_id"), F.col("c_custkey").alias("seq_idx")))


MISSING = "s as (select n_nationkey as id from nation), p as (select distinct c_nationkey as query, s_nationkey as target from customer join supplier on c_custkey % 100 = s_suppkey % 100)"


def _searches(spark, sf_dir):
    c, s = inputs.table(spark, sf_dir, "customer"), inputs.table(spark, sf_dir, "supplier")
    pairs = c.join(s, F.expr("c_custkey % 100 = s_suppkey % 100")).select(F.col("c_nationkey").alias("query"), F.col("s_nationkey").alias("target")).distinct()
    return inputs.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), pairs


@query(f"with {MISSING} select a.id as query, b.id as target from s a cross join s b where (a.id, b.id) not in (select query, target from p)")
def missing_searches(spark, sf_dir):
    return identifiers.missing_pairs(*_searches(spark, sf_dir))


@query(f"with {MISSING} select a.id as query, b.id as target from s a join s b on a.id <= b.id where (a.id, b.id) not in (select query, target from p)")
def missing_searches_one_way(spark, sf_dir):
    return identifiers.missing_pairs(*_searches(spark, sf_dir), both_ways=False)


@query("""with l as (select n_name as name from nation where n_regionkey < 3 union all select n_name from nation where n_regionkey = 0 union all select r_name from region), s as (select n_name as name from nation)
  select name, 'repeated' as problem from l group by name having count(*) > 1 union all select distinct name, 'unknown' from l where name not in (select name from s) union all select name, 'missing' from s where name not in (select name from l)""")  # fmt: skip
def species_tree_problems(spark, sf_dir):
    n, r = inputs.table(spark, sf_dir, "nation"), inputs.table(spark, sf_dir, "region")
    names = n.select(F.col("n_name").alias("name"))
    leaves = n.where("n_regionkey < 3").select(F.col("n_name").alias("name")).union(n.where("n_regionkey = 0").select("n_name")).union(r.select("r_name"))
    return identifiers.tree_problems(leaves, names)


# ---- trees --------------------------------------------------------------------------------------------------------

CORE = "core as (select b.tree, b.node, count(*) filter (p_size <= 5) as n from below b join part on p_partkey = b.leaf group by b.tree, b.node)"


@query(TREE + f", {CORE} select n.tree, n.node, c.n from nodes n join core c on c.node = n.node left join core u on u.node = n.parent where c.n <= 2 and coalesce(u.n, 3) > 2")
def new_clades(spark, sf_dir):
    nodes, paths = _heap(spark, sf_dir)
    core = inputs.table(spark, sf_dir, "part").where("p_size <= 5").select(F.col("p_partkey").alias("leaf"))
    return trees.small_clades(nodes, paths, core, 2)


@query(TREE + ", total as (select sum(dist) as t from nodes where parent is not null) select tree, node, round(case when dist - 1.5 < 0 then 1e-6 * t else dist - 1.5 end, 9) as dist from nodes, total")
def mended_branches(spark, sf_dir):
    nodes = inputs.heap_nodes(spark, sf_dir)
    return trees.mend_branches(nodes.withColumn("total", F.col("dist")).withColumn("dist", F.col("dist") - 1.5), "total").withColumn("dist", F.round("dist", 9))


@query(TREE + ", m as (select tree, node, min(sp) as sp from below group by tree, node having min(sp) = max(sp)) select m.tree, m.node, m.sp from m join nodes n on n.node = m.node left join m u on u.node = n.parent where u.node is null")
def tree_single_species_clades(spark, sf_dir):
    return trees.single_species_clades(*_heap(spark, sf_dir))


# ---- rearrangement ------------------------------------------------------------------------------------------------

#: Orders of four lines, in order of part and supplier, as gene trees (t, (l1, (l2, (l3, l4)))): a line's species is its supplier modulo 4, t is none of them.
QUARTETS = """lines as (select l_orderkey as og, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey) as k, (l_suppkey % 4)::varchar as s from lineitem),
  q as (select og, max(s) filter (k = 1) as s1, max(s) filter (k = 2) as s2, max(s) filter (k = 3) as s3, max(s) filter (k = 4) as s4, max(s || '|' || k::varchar) filter (k = 1) as g1, max(s || '|' || k::varchar) filter (k = 2) as g2,
    max(s || '|' || k::varchar) filter (k = 3) as g3, max(s || '|' || k::varchar) filter (k = 4) as g4 from lines group by og having count(*) = 4)"""


def _quartets(spark, sf_dir):
    li = inputs.table(spark, sf_dir, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("og")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey"))).alias("x")).where(F.size("x") == 4)
    name = lambda k: F.concat((F.col("x")[k - 1]["l_suppkey"] % 4).cast("string"), F.lit(f"|{k}"))
    return lines.select("og", F.format_string("(t|0:1,(%s:1,(%s:2,(%s:3,%s:4):5):6):7);", *map(name, (1, 2, 3, 4))).alias("newick"))


@query(f"""with {QUARTETS},
  -- the pair (l3, l4) has two species, l2 one of them: l2 joins that leaf v (other leaf u), or waits where l1 has u's species and not l2's
  w as (select *, case when s2 = s3 then g3 else g4 end as v, case when s2 = s3 then g4 else g3 end as u, case when s2 = s3 then s4 else s3 end as su, case when s2 = s3 then 3 else 4 end as dv, case when s2 = s3 then 4 else 3 end as du from q),
  kind as (select *, case when s3 <> s4 and s2 in (s3, s4) then case when s1 = su then 'up' when s1 = s2 then 'both' else 'leaf' end
    when s3 = s4 then case when s1 = s2 and s2 <> s3 then 'side' when s1 = s3 and s2 <> s3 then 'pair' else 'none' end
    else case when s1 = s2 then 'side' when s1 = s3 then 'three' when s1 = s4 then 'four' else 'none' end end as kind from w),
  rows as (
    select og, [g1] as x, case kind when 'up' then 0.9 else 1 end as d from kind
    union all select og, [g2], case kind when 'side' then 1.8 else 2 end from kind
    union all select og, [g3], case when kind in ('leaf', 'both') and v = g3 or kind = 'three' then 2.7 else 3 end from kind
    union all select og, [g4], case when kind in ('leaf', 'both') and v = g4 or kind = 'four' then 3.6 else 4 end from kind
    union all select og, ['t|0'], 1 from kind
    union all select og, [g3, g4], case kind when 'pair' then 4.5 else 5 end from kind where kind in ('none', 'up', 'side', 'pair')
    union all select og, [g2, g3, g4], 6 from kind where kind = 'none'
    union all select og, [g1, g2, g3, g4], 7 from kind where kind in ('none', 'up')
    union all select og, [g1, g2], case kind when 'up' then 0.1 else 0.2 end from kind where kind in ('up', 'side')
    union all select og, [g1, g2, g3, g4], 6 from kind where kind in ('side', 'pair', 'three', 'four')
    union all select og, [g1, g3, g4], 0.5 from kind where kind = 'pair'
    union all select og, [g1, g3], 0.3 from kind where kind = 'three' union all select og, [g1, g3, g4], 5 from kind where kind in ('three', 'four') union all select og, [g1, g4], 0.4 from kind where kind = 'four'
    union all select og, [g1, g2, g3, g4], 5 from kind where kind = 'both'
    union all select og, [g2, v], case kind when 'both' then 0.9 else 1 end * 0.1 * dv from kind where kind in ('leaf', 'both')
    union all select og, [g1, g2, v], 0.01 * dv from kind where kind = 'both'
    union all select og, [g2, g3, g4], 5 from kind where kind = 'leaf'
    union all select og, [g1, g2, g3, g4], 7 from kind where kind = 'leaf')
  select og, array_to_string(list_sort(x), ' ') as clade, round(d, 6)::double as dist from rows""")  # fmt: skip
def rearranged_trees(spark, sf_dir):
    """Rearranged gene trees of four lines: each branch's leaves and length."""
    nodes = genetrees.tree_nodes(genetrees.rearranged(_quartets(spark, sf_dir)))
    return trees.clades(nodes).where("parent is not null").select(F.col("tree").alias("og"), F.array_join("leaves", " ").alias("clade"), F.round("dist", 6).alias("dist"))


# ---- kernels held against what SQL can say of trees and graphs with a known answer --------------------------------

LADDER = "((((s0:1,s1:1):1,s2:1):1,s3:1):1,s4:1);"
#: Orders as groups, their lines as genes of five species.
FIVE = """genes as (select distinct l_orderkey as og, 's' || (l_suppkey % 5)::varchar as sp, 's' || (l_suppkey % 5)::varchar || '|' || l_linenumber::varchar as gene from lineitem),
  sized as (select *, count(*) over (partition by og) as n from genes), kept as (select * from sized where n > 1)"""


def _five(spark, sf_dir):
    """(og, sp, gene), and a gene tree a group: the ladder of the species that it has, each with its genes on a ladder of their own."""
    li = inputs.table(spark, sf_dir, "lineitem")
    sp = F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string"))
    genes = li.select(F.col("l_orderkey").alias("og"), sp.alias("sp"), F.concat(sp, F.lit("|"), F.col("l_linenumber").cast("string")).alias("gene")).distinct()
    ladder = lambda xs: F.aggregate(F.slice(xs, F.lit(2), F.size(xs)), xs[0], lambda acc, x: F.concat(F.lit("("), acc, F.lit(":1,"), x, F.lit(":1)")))
    clades = genes.groupBy("og", "sp").agg(F.array_sort(F.collect_list("gene")).alias("g")).select("og", "sp", ladder(F.col("g")).alias("clade"))
    texts = clades.groupBy("og").agg(F.array_sort(F.collect_list(F.struct("sp", "clade"))).alias("c")).select("og", F.transform("c", lambda x: x["clade"]).alias("c"))
    return genes, texts.select("og", F.concat(ladder(F.col("c")), F.lit(";")).alias("newick"))


@query(f"with {FIVE} select a.og, a.gene as a, b.gene as b from kept a join kept b on a.og = b.og and a.sp < b.sp")
def reconciled_pairs(spark, sf_dir):
    """Ortholog pairs of reconciled trees that agree with the species tree: all genes of different species."""
    genes, texts = _five(spark, sf_dir)
    pairs = results.gene_pairs(genetrees.ortholog_sides(genetrees.reconciled(texts, LADDER), genes.select("gene", "sp").distinct()))
    return pairs.select("og", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@query(f"""with {FIVE}, ranked as (select *, row_number() over (partition by og, sp order by gene) as rn, max(sp) over (partition by og) <> min(sp) over (partition by og) as several from kept),
  ladder as (select *, string_agg(gene, ', ' order by gene) over (partition by og, sp order by rn rows between unbounded preceding and 1 preceding) as before,
    string_agg(gene, ', ' order by gene) over (partition by og, sp order by rn rows between 1 following and unbounded following) as after from ranked)
  select og, sp as level, 1.0::double as support, before as genes_1, gene as genes_2 from ladder where several and rn > 1
  union all select og, sp, 1.0, case when rn = n - 1 then gene else after end, case when rn = n - 1 then after else gene end from ladder where not several and rn < n""")  # fmt: skip
def reconciled_duplications(spark, sf_dir):
    """Duplications of the same trees: one for each gene of a species after its first. Trees of one species are rooted on their first leaf."""
    rows = genetrees.reconciled(_five(spark, sf_dir)[1], LADDER).where("kind = 'duplication'")
    sides = F.array_sort(F.array(F.struct(F.size("genes_1").alias("n"), "genes_1"), F.struct(F.size("genes_2").alias("n"), F.col("genes_2").alias("genes_1"))), lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["genes_1"] < b["genes_1"], -1).otherwise(1))
    join = lambda k: F.array_join(F.array_sort(sides[k]["genes_1"]), ", ")
    return rows.select("og", "level", "support", join(0).alias("genes_1"), join(1).alias("genes_2"))


@query(f"""with {FIVE}, levels(level, last) as (values ('N0', 4), ('N1', 3), ('N2', 2), ('N3', 1))
  select og, level, string_agg(gene, ', ' order by gene) as genes from kept join levels on substr(sp, 2)::integer <= last group by og, level""")  # fmt: skip
def reconciled_groups(spark, sf_dir):
    """Hierarchical groups of the same trees: at each level one of all genes of its species."""
    rows = genetrees.reconciled(_five(spark, sf_dir)[1], LADDER).where("kind = 'hog'")
    return rows.select("og", "level", F.array_join(F.array_sort("genes_1"), ", ").alias("genes"))


@query("""with c as (select distinct l_orderkey as og, l_linenumber as k, l_quantity::double as q from lineitem), n as (select og from c group by og having count(*) >= 6 and count(*) = count(distinct k))
  select a.og, a.k::varchar as a, b.k::varchar as b, round(b.k - a.k + a.q + b.q, 6) as dist from c a join c b on a.og = b.og and a.k < b.k where a.og in (select og from n)""")  # fmt: skip
def tree_path_lengths(spark, sf_dir):
    """Neighbour-joining trees of distances along a known tree (a line's twigs in a row, as long as its quantity) have these distances again."""
    c = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("og"), F.col("l_linenumber").alias("k"), F.col("l_quantity").cast("double").alias("q")).distinct()
    n = c.groupBy("og").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("d")).where("n >= 6 and n = d").select("og")
    kept = c.join(n, "og")
    b = kept.select("og", F.col("k").alias("kb"), F.col("q").alias("qb"))
    d = kept.join(b, "og").where("k < kb").select("og", F.col("k").cast("string").alias("a"), F.col("kb").cast("string").alias("b"), (F.col("kb") - F.col("k") + F.col("q") + F.col("qb")).alias("d"))
    nodes = clustering.cut(genetrees.tree_nodes(genetrees.distance_trees(d)))
    leaf = nodes.where("is_leaf").select("tree", "node", "name")
    ends = d.select(F.col("og").alias("tree"), F.col("a").alias("na"), F.col("b").alias("nb"))
    ends = ends.join(leaf.select("tree", F.col("node").alias("a"), F.col("name").alias("na")), ["tree", "na"]).join(leaf.select("tree", F.col("node").alias("b"), F.col("name").alias("nb")), ["tree", "nb"])
    found = trees.distances(trees.routes(nodes), ends.select("tree", "a", "b"))
    return found.join(ends, ["tree", "a", "b"]).select(F.col("tree").alias("og"), F.col("na").alias("a"), F.col("nb").alias("b"), "dist")


@query("select c_custkey as gene, (min(c_custkey) over (partition by c_custkey // 8))::bigint as og from customer")
def markov_cliques(spark, sf_dir):
    """Flow clusters of cliques of eight customers, each tied to the next by a weak edge (no tie after every hundredth): the cliques."""
    c = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q"), F.floor(F.col("c_custkey") / 8).alias("clique"))
    inside = c.join(c.withColumnRenamed("q", "h"), "clique").where("q < h").select("q", "h", F.lit(1.0).alias("weight"))
    ties = c.where("q % 8 = 7 and clique % 100 <> 99").select("q", (F.col("q") + 1).alias("h"), F.lit(0.02).alias("weight")).join(c.select(F.col("q").alias("h")), "h", "left_semi")
    return clustering.markov(inside.unionByName(ties.select("q", "h", "weight")), inflation=2.0)


# ---- profiles: documents of the sources numbered under ten are members of known groups (by length), the others are new genes ----------------------

CORE_DOCS = """core as (select doc_id as gene, source as sp, n_chars % 40 as og from documents where length(source) = 4), fresh as (select doc_id as gene, source as sp from documents where length(source) <> 4),
  profile as materialized (select og, sp, gene from (select *, row_number() over (partition by og order by md5('0:' || gene::varchar), gene) as rn from core) where rn <= 5),
  w as (select doc_id as gene, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as w from documents),
  s as materialized (select gene, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) as piece from w where len(w) >= 5),
  hits as materialized (select a.gene, p.og, p.sp, p.gene as hit, -count(*)::double as evalue from s a join fresh f on f.gene = a.gene join s b on a.piece = b.piece join profile p on p.gene = b.gene group by all having count(*) >= 3),
  best as (select gene, og, sp as hit_sp from (select *, row_number() over (partition by gene order by evalue, og, sp) as rn from hits) where rn = 1)"""


def _core_docs(spark, sf_dir):
    docs = inputs.document_genes(spark, sf_dir)
    core = docs.where("length(sp) = 4").select((F.col("len") % 40).alias("og"), "sp", "gene")
    return core, docs.where("length(sp) <> 4"), docs


def _profile_hits(spark, sf_dir):
    core, fresh, docs = _core_docs(spark, sf_dir)
    pieces = profiles.word_pieces(5)
    index = profiles.profile_index(profiles.profiles(core, 5, "random"), docs, pieces)
    return profiles.profile_hits(fresh.select("gene", "seq"), index, pieces)


@query(f"with {CORE_DOCS} select og, sp, gene from profile")
def profile_members(spark, sf_dir):
    return profiles.profiles(_core_docs(spark, sf_dir)[0], 5, "random")


@query(f"with {CORE_DOCS} select gene, og, sp, hit, evalue from hits")
def profile_hits(spark, sf_dir):
    """New documents against the profiles of known groups, by shared runs of five words."""
    return _profile_hits(spark, sf_dir)


@query(f"with {CORE_DOCS} select gene, og, hit_sp from best")
def profile_assignment(spark, sf_dir):
    return similarity.assign(_profile_hits(spark, sf_dir))


@query(f"with {CORE_DOCS}, per as (select gene, og, min(evalue) as evalue from hits group by gene, og) select gene, og, evalue from (select *, min(evalue) over (partition by gene) as best from per) where evalue - best < 10")
def profile_close_groups(spark, sf_dir):
    return profiles.close_groups(_profile_hits(spark, sf_dir))


@query(f"with {CORE_DOCS} select sp, hit_sp, n from (select f.sp, hit_sp, count(*) as n, row_number() over (partition by f.sp order by count(*) desc, hit_sp) as rn from best join fresh f using (gene) group by f.sp, hit_sp) where rn = 1")
def profile_closest_species(spark, sf_dir):
    return similarity.closest_species(similarity.assign(_profile_hits(spark, sf_dir)), _core_docs(spark, sf_dir)[1])


@query(f"""with {CORE_DOCS}, grown as (select og, gene from core union all select og, gene from best), sized as (select og, count(*) as n from grown group by og having count(*) > 1)
  select doc_id as gene, source as sp from documents where doc_id not in (select gene from grown where og in (select og from sized))""")  # fmt: skip
def profile_unassigned(spark, sf_dir):
    """Genes of any species that no group of two or more has after the new ones are assigned."""
    from cladeforge.operators import orthogroups

    core, fresh, docs = _core_docs(spark, sf_dir)
    added = similarity.assign(_profile_hits(spark, sf_dir)).join(fresh.select("gene", "sp"), "gene").select("og", "sp", "gene")
    return orthogroups.not_grouped(core.unionByName(added), docs.select("gene", "sp")).select("gene", "sp")


#: Parts as aligned rows: ten letters of the name, anything else a gap; sizes are groups.
ROWS_OF_TEN = """aligned as (select p_size as og, p_partkey as gene, regexp_replace(rpad(substr(upper(p_name), 1, 10), 10, '-'), '[^A-Z]', '-', 'g') as aligned from part where p_partkey is not null and p_name is not null),
  gaps as (select og, gene, len(aligned) - len(replace(aligned, '-', '')) as g from aligned), bar as (select og, count(*) as n, quantile_cont(g, 0.75) as bar from gaps group by og)"""


@query(f"with {ROWS_OF_TEN} select og, case when any_value(n) <= 12 then any_value(n) else least(12, count_if(g <= bar)) end as n from gaps join bar using (og) group by og")
def representative_counts(spark, sf_dir):
    """How many representatives of at most twelve each aligned group has (tests hold which ones they are against brute force)."""
    p = inputs.table(spark, sf_dir, "part").where("p_partkey is not null and p_name is not null")
    row = F.regexp_replace(F.rpad(F.substring(F.upper("p_name"), 1, 10), 10, "-"), "[^A-Z]", "-")
    chosen = profiles.from_alignments(p.select(F.col("p_size").alias("og"), F.col("p_partkey").alias("gene"), row.alias("aligned")), 12)
    return chosen.groupBy("og").agg(F.count(F.lit(1)).alias("n"))


@query()
def piece_representatives(spark, sf_dir):
    """Twelve parts that stand for all, by the three-letter pieces of their names (tests hold them against brute force)."""
    p = inputs.table(spark, sf_dir, "part").where("p_name is not null")
    return profiles.from_pieces(p.select(F.col("p_partkey").alias("gene"), F.lower("p_name").alias("seq")), 12)


# ---- species trees: orders of four lines of four species, as above, with t a fifth --------------------------------

FIVE_TAXA = ["0", "1", "2", "3", "t"]
#: Each tree's splits as masks (species k is bit k, t is bit 4) turned so that bit 0 is clear, and their lengths once the root is gone.
SPLITS = QUARTETS + """, four as (select og, s1::integer as a, s2::integer as b, s3::integer as c, s4::integer as d from q where s1 <> s2 and s1 <> s3 and s1 <> s4 and s2 <> s3 and s2 <> s4 and s3 <> s4),
  raw as (select og, 16 as m, 8.0 as length from four union all select og, 1 << a, 1 from four union all select og, 1 << b, 2 from four union all select og, 1 << c, 3 from four union all select og, 1 << d, 4 from four
    union all select og, (1 << c) + (1 << d), 5 from four union all select og, (1 << b) + (1 << c) + (1 << d), 6 from four),
  splits as (select og, case when m & 1 = 1 then 31 - m else m end as m, length::double as length from raw),
  counted as (select m, count(*) as n, avg(length) as length from splits group by m),
  inner_ones as (select *, bit_count(m) as k from counted where bit_count(m) between 2 and 3)"""
NAMES_OF = "array_to_string(list_filter([case when m & 1 > 0 then '0' end, case when m & 2 > 0 then '1' end, case when m & 4 > 0 then '2' end, case when m & 8 > 0 then '3' end, case when m & 16 > 0 then 't' end], lambda x: x is not null), ' ')"


def _species_splits(spark, sf_dir):
    return species_trees.tree_splits(species_trees.closest_species_trees(_quartets(spark, sf_dir), FIVE_TAXA), FIVE_TAXA)


@query(f"with {SPLITS} select og, {NAMES_OF} as split, length from splits")
def species_tree_splits(spark, sf_dir):
    """Splits of the species trees of all gene trees with every species."""
    rows = _species_splits(spark, sf_dir)
    return rows.select("og", F.array_join(species_trees.taxa_of(F.col("split"), FIVE_TAXA), " ").alias("split"), F.round("length", 6).alias("length"))


@query(f"with {SPLITS} select {NAMES_OF} as split, n, round(length, 6) as length from counted")
def species_split_counts(spark, sf_dir):
    rows = species_trees.split_counts(_species_splits(spark, sf_dir))
    return rows.select(F.array_join(species_trees.taxa_of(F.col("split"), FIVE_TAXA), " ").alias("split"), "n", F.round("length", 6).alias("length"))


@query(f"""with {SPLITS}, one as (select * from inner_ones order by n desc, m limit 1), two as (select i.* from inner_ones i, one o where i.m <> o.m and (i.m & o.m) in (0, i.m, o.m) order by i.n desc, i.m limit 1),
  total as (select count(*) as trees from four), every as (select m, n, length from one union all select m, n, length from two union all select m, n, length from counted where bit_count(m) in (1, 4))
  select case when bit_count(m) = 4 then '0' else {NAMES_OF} end as split, case when bit_count(m) not in (1, 4) then n end as n_trees, trees, round(length, 5) as length from every, total""")  # fmt: skip
def consensus_branches(spark, sf_dir):
    """Branches of the greedy consensus of those species trees."""
    text, n = species_trees.consensus_tree(species_trees.closest_species_trees(_quartets(spark, sf_dir), FIVE_TAXA), FIVE_TAXA)
    nodes = genetrees.tree_nodes(spark.createDataFrame([(0, text)], "og long, newick string"))  # one tree
    full = nodes.join(trees.clades(nodes).select("tree", "node", "leaves"), ["tree", "node"]).where("parent is not null")
    return full.select(F.array_join("leaves", " ").alias("split"), F.when(~F.col("is_leaf"), F.round(F.col("support") * n).cast("long")).alias("n_trees"), F.lit(n).cast("long").alias("trees"), F.round("dist", 5).alias("length"))


# ---- reconciled locus trees: the same orders of four lines, m0 to m3 from the top; the order's number says which nodes are speciations --------------

LOCUS = QUARTETS + """, sides as (select og, 0 as node, 't' as sa, 't|0' as a, unnest([s1, s2, s3, s4]) as sb, unnest([g1, g2, g3, g4]) as b from q where og % 2 = 0
    union all select og, 1, s1, g1, unnest([s2, s3, s4]), unnest([g2, g3, g4]) from q where og % 3 <> 0 union all select og, 2, s2, g2, unnest([s3, s4]), unnest([g3, g4]) from q where og % 5 <> 0 union all select og, 3, s3, g3, s4, g4 from q where og % 7 <> 0),
  pairs as (select og, sa, og::varchar || '.' || a as a, sb, og::varchar || '.' || b as b from sides where sa <> sb)"""


def _locus_pairs(spark, sf_dir):
    inner = F.regexp_replace("newick", r"\):5\):6\):7\);", "):5)m2:6)m1:7)m0;")
    texts = _quartets(spark, sf_dir).select("og", F.regexp_replace(F.regexp_replace(inner, r":4\):5", ":4)m3:5"), r"(?<=[(,])([^(),:|]+\|)", F.concat(F.col("og").cast("string"), F.lit(".$1"))).alias("newick"))
    nodes = clustering.cut(genetrees.tree_nodes(texts))
    rule = {"m0": "tree % 2 = 0", "m1": "tree % 3 <> 0", "m2": "tree % 5 <> 0", "m3": "tree % 7 <> 0"}
    event = F.coalesce(*(F.when((F.col("name") == n) & F.expr(cond), "spec") for n, cond in rule.items()), F.lit("dup"))
    events = nodes.where("not is_leaf").select("tree", F.when((F.col("name") == "m0") & (F.col("tree") % 4 == 0), "gone").otherwise(F.col("name")).alias("name"), event.alias("event"))
    genes = nodes.where("is_leaf").select(F.col("name").alias("gene"), F.regexp_extract("name", r"\.([^|]*)", 1).alias("sp"))
    sides = results.locus_sides(nodes, events, genes)
    other = sides.where("side = 1").select("og", "node", F.col("sp").alias("sp_b"), F.col("gene").alias("b"))
    return sides.where("side = 0").join(other, ["og", "node"]).where("sp <> sp_b").select("og", F.col("sp").alias("sp_a"), F.col("gene").alias("a"), "sp_b", "b")


@query(f"with {LOCUS} select og, a, b from pairs")
def locus_orthologs(spark, sf_dir):
    return _locus_pairs(spark, sf_dir).select("og", "a", "b")


@query(f"""with {LOCUS}, ways as (select sa, a, sb, b from pairs union select sb, b, sa, a from pairs), sets as (select sa, sb, a, string_agg(b, ', ' order by b) as genes_b from ways group by sa, sb, a)
  select sa as sp_a, sb as sp_b, string_agg(a, ', ' order by a) as genes_a, genes_b from sets group by sa, sb, genes_b""")  # fmt: skip
def locus_ortholog_classes(spark, sf_dir):
    one = _locus_pairs(spark, sf_dir).select("sp_a", "a", "sp_b", "b")
    return results.ortholog_classes(one.unionByName(one.select(F.col("sp_b").alias("sp_a"), F.col("b").alias("a"), F.col("sp_a").alias("sp_b"), F.col("a").alias("b"))))


#: Columns of the aligned rows above, brands as species; single-copy rows alone, by groups that have at least a third of the species so.
@query(f"""with {ROWS_OF_TEN}, m as (select og, gene, p_brand as sp, aligned from aligned join part on p_partkey = gene), species as (select distinct sp from m), total as (select count(*) as n_species from species),
  single as (select og, sp, any_value(aligned) as aligned from m group by og, sp having count(*) = 1), chosen as (select og from single, total group by og, n_species having count(*) > 0.2 * n_species),
  letters as (select og, sp, i, aligned[i] as c from single join chosen using (og), (select unnest(range(1, 11)) as i)),
  kept as (select og, i from letters, total group by og, i, n_species having count_if(c = '-') + n_species - count(*) <= 0.9 * n_species)
  select species.sp as sp, string_agg(coalesce(c, '-'), '' order by kept.og, kept.i) as row from species cross join kept left join letters on letters.sp = species.sp and letters.og = kept.og and letters.i = kept.i group by species.sp""")  # fmt: skip
def concatenated_alignment(spark, sf_dir):
    """Species' single-copy rows side by side, without columns of gaps."""
    p = inputs.table(spark, sf_dir, "part").where("p_partkey is not null and p_name is not null")
    row = F.regexp_replace(F.rpad(F.substring(F.upper("p_name"), 1, 10), 10, "-"), "[^A-Z]", "-")
    m = p.select(F.col("p_size").alias("og"), F.col("p_brand").alias("sp"), F.col("p_partkey").alias("gene"), row.alias("aligned"))
    n_species = m.select("sp").distinct().count()
    single = m.groupBy("og", "sp").agg(F.count(F.lit(1)).alias("n")).where("n = 1").groupBy("og").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0.2 * n_species)
    return genetrees.concatenated(m, m, single, share=0.2)


@query(f"with {QUARTETS} select og, '(t|0:1,(p' || s1 || '-1:1,(p' || s2 || '-2:2,(p' || s3 || '-3:3,p' || s4 || '-4:4):5):6):7);' as newick from q")
def renamed_trees(spark, sf_dir):
    """Trees of four lines with other names for their leaves; t keeps its own."""
    names = spark.range(4).crossJoin(spark.range(1, 5).withColumnRenamed("id", "k")).select(F.concat_ws("|", F.col("id").cast("string"), F.col("k").cast("string")).alias("gene"), F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("name"))  # sixteen rows
    return genetrees.renamed(_quartets(spark, sf_dir), names)


# ---- alignments as rows ---------------------------------------------------------------------------------------------


def _rows_of_ten(spark, sf_dir):
    p = inputs.table(spark, sf_dir, "part").where("p_partkey is not null and p_name is not null")
    row = F.regexp_replace(F.rpad(F.substring(F.upper("p_name"), 1, 10), 10, "-"), "[^A-Z]", "-")
    return p.select(F.col("p_size").alias("og"), F.col("p_partkey").alias("gene"), row.alias("aligned"))


LETTERS = ROWS_OF_TEN + """, letters as (select og, gene, i, aligned[i + 1] as c from aligned, (select unnest(range(0, 10)) as i)), per as (select og, i, c, count(*) as n from letters group by all),
  cols as (select og, i as pos, sum(n)::bigint as n_rows, coalesce(sum(n) filter (c <> '-'), 0)::bigint as n_letters, count(*) filter (c <> '-') as n_kinds, (min((-n, c)) filter (c <> '-'))[2] as top, max(n) filter (c <> '-') as n_top from per group by og, i)"""


@query(f"with {LETTERS} select * from cols")
def alignment_columns(spark, sf_dir):
    """Residues of each column of the rows, and the most frequent one."""
    return alignments.columns(_rows_of_ten(spark, sf_dir))


@query(f"with {LETTERS} select og, gene, i as pos, c as letter from letters where c <> '-'")
def alignment_cells(spark, sf_dir):
    return alignments.cells(_rows_of_ten(spark, sf_dir))


#: Of ten columns those stay that have residues in 95 % of the rows, or as many as let six columns and 70 % of the residues stay.
KEPT = LETTERS + """, stay as (select a.og, a.n_letters, any_value(a.n_rows) as n_rows, count(*) as cols, sum(b.n_letters) as letters from (select distinct og, n_letters, n_rows from cols) a join cols b on a.og = b.og and b.n_letters >= a.n_letters group by a.og, a.n_letters),
  total as (select og, sum(n_letters) as total from cols group by og), least as (select og, least(0.95 * any_value(n_rows), max(n_letters) filter (cols >= 6 and letters >= 0.7 * total)) as least from stay join total using (og) group by og)"""


@query(f"with {KEPT} select a.og, a.gene, string_agg(a.c, '' order by a.i) as aligned from letters a join cols on cols.og = a.og and cols.pos = a.i join least on least.og = a.og where cols.n_letters >= least.least group by a.og, a.gene")
def trimmed_rows(spark, sf_dir):
    """The rows without sparse columns."""
    return alignments.trimmed(_rows_of_ten(spark, sf_dir), least_share=0.95, least_columns=6, least_letters=0.7).select("og", "gene", "aligned")


@query(f"with {ROWS_OF_TEN} select og, gene, aligned from aligned where og in (select og from aligned group by og having count(distinct aligned) >= 38)")
def varied_alignments(spark, sf_dir):
    """Rows of groups with many different ones."""
    return alignments.varied(_rows_of_ten(spark, sf_dir), 38).select("og", "gene", "aligned")


@query(f"with {ROWS_OF_TEN} select og, 0 as part, '' as gene, '# STOCKHOLM 1.0' || chr(10) || '#=GF AC ' || og::varchar as line from aligned group by og union all select og, 1, gene::varchar, gene::varchar || ' ' || aligned from aligned union all select og, 2, '', '//' from aligned group by og")
def stockholm_lines(spark, sf_dir):
    """Alignments in Stockholm format, a line a row."""
    return alignments.stockholm(_rows_of_ten(spark, sf_dir))


@query(f"with {ROWS_OF_TEN} select og, p_brand || '|' || gene::varchar as gene, aligned from aligned join part on p_partkey = gene")
def renamed_alignments(spark, sf_dir):
    names = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.concat_ws("|", "p_brand", F.col("p_partkey").cast("string")).alias("name"))
    return alignments.renamed(_rows_of_ten(spark, sf_dir), names).select("og", "gene", "aligned")


@query("""with genes as (select p_partkey::varchar as gene, p_brand as sp, p_size as og from part where p_partkey is not null), numbered as (select *, row_number() over (order by sp, gene) - 1 as id from genes),
  lines as (select 0 as part, '<orthoXML version="0.3" origin="cladeforge" xmlns="http://orthoXML.org/2011/">' as line union all select 2, '  <groups>' union all select 4, '  </groups>' || chr(10) || '</orthoXML>'
    union all select distinct 1, '  <species name="' || sp || '">' || chr(10) || '    <database>' || chr(10) || '      <genes>' from genes
    union all select 1, '        <gene id="' || id::varchar || '" geneId="' || gene || '"/>' from numbered
    union all select 1, '      </genes>' || chr(10) || '    </database>' || chr(10) || '  </species>' from (select distinct sp from genes)
    union all select distinct 3, '    <orthologGroup id="' || og::varchar || '">' from genes union all select 3, '      <geneRef id="' || id::varchar || '"/>' from numbered
    union all select 3, '    </orthologGroup>' from (select distinct og from genes)) select * from lines""")  # fmt: skip
def orthoxml_lines(spark, sf_dir):
    """Parts as genes, sizes as groups, brands as species, as an OrthoXML document's lines."""
    p = inputs.table(spark, sf_dir, "part").where("p_partkey is not null")
    return sinks.orthoxml(p.select(F.col("p_size").alias("og"), F.col("p_brand").alias("sp"), F.col("p_partkey").alias("gene"))).select("part", "line")
