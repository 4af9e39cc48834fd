"""Registered queries: candidate generation from table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge import config as C
from rankforge.functions import sequences as S, text
from rankforge.operators import generation as G, joins
from rankforge.plans import standins as V
from rankforge.plans.registry import query, rounded, rounded_sql

AA = "'ACDEFGHIKLMNPQRSTVWY'"


def h(*parts: str) -> str:
    """The seeded 32-bit number of the parts, as SQL."""
    return f"CAST(('0x' || substr(md5('42:' || {' || chr(58) || '.join(parts)}), 1, 8)) AS BIGINT)"


def order_ids(spark: SparkSession, folder: str) -> DataFrame:
    return V.read_spread(spark, folder, "orders", "o_orderkey")


@query("g01_j01_pair_products", V.sql("reactants", """
SELECT a.name AS aldehyde, b.name AS amine, 'C(=N' || substr(b.smiles, 2) || ')' || substr(a.smiles, 4) AS product
FROM reactants a, reactants b
WHERE a.type = 'aldehyde' AND b.type = 'amine' AND a.smiles LIKE 'O=C%' AND regexp_matches(b.smiles, '^N[A-Za-z(\\[]')"""))
def pair_products(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.reactants(spark, folder)
    return joins.imines(rows.filter("type = 'aldehyde'"), rows.filter("type = 'amine'"))


RANDOM_SQL = f"""SELECT o_orderkey, array_to_string(list_transform(range(1, 11 + {h('o_orderkey', "'len'")} % 41),
  lambda i: substr({AA}, CAST(1 + {h('o_orderkey', 'i')} % 20 AS INT), 1)), '') AS sequence FROM orders"""


@query("g02_c07_c18_random_sequences", RANDOM_SQL)
def random_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return order_ids(spark, folder).withColumn("sequence", S.random_sequence(F.col("o_orderkey")))


HELICAL_SQL = f"""SELECT o_orderkey, array_to_string(list_transform(range(1, 1 + len), lambda i:
    CASE WHEN i <= npos THEN substr('RKH', CAST(1 + {h('o_orderkey', 'i')} % 3 AS INT), 1)
         WHEN i <= npos + floor(len * 0.4) THEN substr('AILMFVWP', CAST(1 + {h('o_orderkey', 'i')} % 8 AS INT), 1)
         ELSE substr({AA}, CAST(1 + {h('o_orderkey', 'i')} % 20 AS INT), 1) END), '') AS sequence
  FROM (SELECT o_orderkey, 15 + {h('o_orderkey', "'len'")} % 16 AS len, 2 + {h('o_orderkey', "'pos'")} % 4 AS npos FROM orders)"""


@query("g03_g04_helical_and_cyclic", f"""
SELECT o_orderkey, sequence, 'C' || substr(sequence, 2, length(sequence) - 2) || 'C' AS cyclic FROM ({HELICAL_SQL})""")
def helical(spark: SparkSession, folder: str) -> DataFrame:
    rows = order_ids(spark, folder).withColumn("sequence", S.helical_sequence(F.col("o_orderkey")))
    return rows.withColumn("cyclic", S.cyclic_sequence(F.col("sequence")))


@query("g05_motif_mutation", V.sql("peptides", f"""
SELECT pep_id, list_reduce(string_split('ACDEFGHIKLMNPQRSTVWY', ''), lambda acc, a:
    CASE WHEN instr(acc, a) > 0 THEN substr(acc, 1, instr(acc, a) - 1)
      || substr({AA}, CAST(1 + {h('pep_id', 'a')} % 20 AS INT), 1) || substr(acc, instr(acc, a) + 1) ELSE acc END,
    sequence) AS mutated
FROM peptides"""))
def mutation(spark: SparkSession, folder: str) -> DataFrame:
    return V.peptides(spark, folder).select(
        "pep_id", S.mutate_motif(F.col("sequence"), F.col("pep_id")).alias("mutated"))


@query("g06_wildcard_fill", f"""
SELECT o_orderkey, array_to_string(list_transform(range(0, length(motif)), lambda i:
    CASE WHEN motif[i + 1] = 'X' THEN substr({AA}, CAST(1 + {h('o_orderkey', 'i')} % 20 AS INT), 1)
         ELSE motif[i + 1] END), '') AS filled
FROM (SELECT o_orderkey, ['KXKXXXXKXK', 'GXXLXK', 'XXXX', 'KLK'][CAST(1 + o_orderkey % 4 AS INT)] AS motif FROM orders)""")
def wildcards(spark: SparkSession, folder: str) -> DataFrame:
    rows = order_ids(spark, folder)
    motif = V.choose(["KXKXXXXKXK", "GXXLXK", "XXXX", "KLK"], F.col("o_orderkey") % 4)
    return rows.select("o_orderkey", S.fill_wildcards(motif, F.col("o_orderkey")).alias("filled"))


def rules_sql(rules: list[tuple[str, str]], n: int, low: int, span: int) -> str:
    """n rule applications per molecule, written with SQL lists."""
    entries = ", ".join(
        f"{{'h': {h('mol_id', 'v', repr(f'rule{i}'))}, 'i': {i}, 't': '{t}', 'r': '{r}'}}"
        for i, (t, r) in enumerate(rules))
    replaced = """CASE WHEN instr(acc, x.t) > 0 THEN substr(acc, 1, instr(acc, x.t) - 1) || x.r
      || substr(acc, instr(acc, x.t) + length(x.t)) ELSE acc END"""
    return f"""drawn AS (
  SELECT mol_id, smiles, v, list_sort([{entries}]) AS rules, {low} + {h('mol_id', 'v', "'k'")} % {span} AS k
  FROM molecules, range(1, {n + 1}) AS r(v) WHERE {{where}}),
-- the start value is wrapped as the first list entry because the fold runs over one list
made AS (
  SELECT mol_id, v, (list_reduce([{{'t': '', 'r': '', 's': smiles}}] || list_transform(rules[1:k],
    lambda x: {{'t': x.t, 'r': x.r, 's': ''}}), lambda a, x: {{'t': '', 'r': '', 's':
      {replaced.replace('acc', 'a.s')}}})).s AS product FROM drawn)"""


VALID_START = V.valid_sql("smiles")
ANALOG_CTE = rules_sql(C.ANALOG_RULES, 6, 1, 3).replace("{where}", VALID_START)
HOP_CTE = rules_sql(C.HOP_RULES, 3, 1, 1).replace("{where}", VALID_START)
MIMIC_CTE = rules_sql(C.MIMIC_RULES, 3, 3, 1).replace("{where}", "true")
ANALOG_ROWS = f"""SELECT mol_id, CAST(v AS INT) AS variant, product FROM (
  SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY v) AS r FROM (
    SELECT mol_id, 0 AS v, smiles AS product FROM molecules WHERE {VALID_START}
    UNION ALL SELECT mol_id, v, product FROM made WHERE {V.valid_sql('product')})) WHERE r <= 6"""


@query("g07_c04_analogs", V.sql("molecules", f"WITH {ANALOG_CTE} {ANALOG_ROWS}"))
def analogs(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    return G.analogs(rows, "smiles", "mol_id", 6).select("mol_id", "variant", "product")


@query("g08_scaffold_hops", V.sql("molecules", f"""
WITH {HOP_CTE} SELECT mol_id, CAST(v AS INT) AS variant, product FROM made WHERE {V.valid_sql('product')}"""))
def hops(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    return G.scaffold_hops(rows, "smiles", "mol_id", 3).select("mol_id", "variant", "product")


@query("g11_backbone_mimics", V.sql("molecules", f"""
WITH {MIMIC_CTE} SELECT mol_id, CAST(v AS INT) AS variant, product FROM made WHERE {V.valid_sql('product')}"""))
def mimics(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    return G.backbone_mimics(rows, "smiles", "mol_id", 3).select("mol_id", "variant", "product")


@query("g09_c05_hybrids", V.sql("molecules", """
SELECT DISTINCT string_split(d, '.')[1] || 'CCC' || string_split(d, '.')[-1] AS product
FROM (SELECT smiles || '.' || repeat('O', brand) AS d FROM molecules)"""))
def hybrids(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select(
        F.concat("smiles", F.lit("."), F.expr("repeat('O', brand)")).alias("dotted"))
    return rows.select(G.hybrid(F.col("dotted")).alias("product")).distinct()


THREE_PART_SQL = f"""SELECT mol_id, linker, product FROM (
  SELECT mol_id, linker, smiles || l || 'O=C(NCC1=CC=CC=C1)C2=CC=C(O)C=C2' AS product FROM molecules,
    (VALUES ('short', 'CCC'), ('medium', 'CCCCCC'), ('long', 'CCCCCCCCCC'), ('PEG', 'CCOCCOCC'), ('aryl', 'c1ccccc1')) AS t(linker, l))
  WHERE {V.valid_sql('product')}"""


@query("g10_three_part", V.sql("molecules", THREE_PART_SQL))
def three_part(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    return G.three_part(rows).select("mol_id", "linker", "product")


def fragment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments of a molecule: start structure, tail, brand chain, linker."""
    m = V.molecules(spark, folder)
    return m.select("mol_id", "smiles", F.array(
        V.choose([s for _, s in C.STARTING_POINTS], F.col("mol_id") % 10),
        F.expr("repeat('C', brand)"), F.lit("c1ccccc1"), F.concat(F.lit("N"), F.expr("repeat('O', brand)")),
    ).alias("fragments"))


FRAGMENT_CTE = f"""parts AS (
  SELECT mol_id, smiles, [start_smiles, repeat('C', brand), 'c1ccccc1', 'N' || repeat('O', brand)] AS fragments
  FROM (SELECT *, ['CC(=O)CC(C)=CC1=CC=C(O)C(OC)=C1', 'OC1=CC=C(C=C1)C=CC1=CC(O)=CC(O)=C1',
     'OC1=C(O)C=C2C(=O)C3C(O)=C(O)C(C3OC2=C1)=O', 'CC1(C)OC2=C(C1)OC3=C(C2=O)C=C(C=C3O)C4=CC(C5=C(C=C(C5)O)O)C(=O)O',
     'OC1=CC=C(O)C(CO)=C1', 'OC1=CC=C(C=CC(O)=O)C1', 'COC1=C(C=CC(=C1)C=CC(O)=O)C',
     'OC1=CC(O)=C(O)C(O)=C1', 'OC1=C(O)C2=C(C=C1O)C1=C(O)C(=O)C3=C(O)C(O)=C(O)C3=C1C2=O',
     'OC1C2C(OC3=C(C2=O)C=C(C=C3O)C1CO)CO'][CAST(1 + mol_id % 10 AS INT)] AS start_smiles FROM molecules)),
joined AS (
  SELECT mol_id, CAST(v AS INT) AS variant, array_to_string(list_transform(list_sort(list_transform(range(0, 4), lambda i:
    {{'h': {h('mol_id', 'v', 'i')}, 'i': i, 'f': fragments[i + 1]}}))[1:3], lambda x: x.f), '.') AS product
  FROM parts, range(1, 5) AS r(v)),
recombined AS (SELECT * FROM joined WHERE {V.valid_sql('product')})"""


@query("g12_fragment_recombination", V.sql("molecules", f"WITH {FRAGMENT_CTE} SELECT mol_id, variant, product FROM recombined"))
def recombination(spark: SparkSession, folder: str) -> DataFrame:
    return G.recombine_fragments(fragment_rows(spark, folder), "fragments", "mol_id", 4).select("mol_id", "variant", "product")


@query("g13_copies", V.sql("molecules", "SELECT smiles, count(*) * 10 AS n FROM molecules GROUP BY smiles"))
def copies(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.copies(V.molecules(spark, folder).select("smiles"), 10)
    return rows.groupBy("smiles").agg(F.count("*").alias("n"))


HYBRID_SET_HOPS = HOP_CTE.replace("drawn", "drawn_hops").replace("made", "made_hops")


@query("g14_hybrid_set", V.sql("molecules", f"""
WITH {ANALOG_CTE}, {HYBRID_SET_HOPS}
SELECT product FROM ({ANALOG_ROWS}) UNION SELECT product FROM made_hops WHERE {V.valid_sql('product')}"""))
def hybrid_set(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    return G.hybrid_set(rows, "smiles", "mol_id", 6)


@query("g15_degrader_set", V.sql("molecules", f"""
WITH {FRAGMENT_CTE} SELECT product FROM ({THREE_PART_SQL}) UNION SELECT product FROM recombined"""))
def degrader_set(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrader_set(fragment_rows(spark, folder), "smiles", "fragments", "mol_id", 8)


@query("g16_u03_labelled_training_rows", rounded_sql(f"""
WITH joined AS (
  SELECT o_orderkey * 2 + 1 AS row_id, sequence, 1 AS activity FROM ({HELICAL_SQL})
  UNION ALL SELECT o_orderkey * 2, sequence, 0 FROM ({RANDOM_SQL}))
SELECT row_id, sequence, activity,
  CASE WHEN activity = 1 THEN 1.0 + {h('row_id', "'mic'")} / 4294967296.0::DOUBLE * 31.0
       ELSE 64.0 + {h('row_id', "'mic'")} / 4294967296.0::DOUBLE * 192.0 END AS mic,
  ['E. coli', 'S. aureus', 'P. aeruginosa', 'B. subtilis', 'K. pneumoniae'][CAST(1 + row_id % 5 AS INT)] AS target
FROM joined""", "mic", 6))
def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(G.add_assay(generated_training_rows(spark, folder), "row_id"), 6)


def generated_training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A helical sequence as an active and a random one as an inactive for every order."""
    rows, k = order_ids(spark, folder), F.col("o_orderkey")
    return G.label_union(
        rows.select((k * 2 + 1).alias("row_id"), S.helical_sequence(k).alias("sequence")),
        rows.select((k * 2).alias("row_id"), S.random_sequence(k).alias("sequence")))
