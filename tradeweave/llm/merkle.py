"""Merkle manifest of a dataset: a tree of threes for each source, one over their roots, and a proof of each row by octopus multiproofs.

1. Leaves are hashed beside the texts; only digests go on. They are dealt by range of (source, doc_id) into partitions of about
   LEAVES; counts of partitions and sources, summed up, give each leaf its place in its source.
2. Runs of 3**STRIDE nodes are hashed up STRIDE levels in a task, then the nodes so gained, and so on to the roots.
3. A leaf partition holds a contiguous range of leaves. It computes, from its ranges alone, the smallest set of nodes that it can't
   derive and that its proofs need (the octopus): on each level what is lacking to whole runs at both ends. All partitions
   fetch theirs in one join.
4. Each partition derives the interior nodes that its proofs share, and expands and folds the proofs of its leaves.

Null source: a source of its own, before all others. Null doc_id: before all others of its source, and its text isn't tampered with.
Rows of one doc_id are ordered by leaf; equal rows have equal leaves at places of their own, each with its proof. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, own, ship, table

#: Children of a node (fixed), levels hashed in one task, leaves of a partition, sources of a partition of their ranking.
ARITY, STRIDE, LEAVES, SOURCES = 3, 7, 32_768, 100_000
#: The tree over the subroots; a source's tree is its rank.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, level int, idx long, digest binary, n long, top boolean"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def H(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(row: dict[str, Column]) -> Column:
    """The digest of a row's fields, in binary."""
    text = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (row[f].cast("string") for f in FIELDS)]
    return F.unhex(F.sha2(F.concat(*text), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, tampered): tampered is null where it is the leaf."""
    row = {f: F.col(f) for f in FIELDS}
    bare = row | {"text": F.translate("text", "\n", "")}
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    return own(docs, *FIELDS).select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(row).alias("leaf"), F.when(changed, leaf_of(bare)).alias("tampered"))


def missing(lo: int, hi: int, n: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes that leaves lo to hi - 1 of n lack for the proofs of them all, and can't derive."""
    level = 0
    while n > 1:
        begin, end = lo // ARITY * ARITY, min(n, -(-hi // ARITY) * ARITY)
        yield from ((level, i) for i in (*range(begin, lo), *range(hi, end)))
        lo, hi, n, level = begin // ARITY, -(-hi // ARITY), -(-n // ARITY), level + 1


class Branch:
    """The nodes that a range of leaves can derive, with those it lacks; run(level, i): the run of the i-th node there."""

    def __init__(self, lo: int, leaves: list[str], n: int, lacking: dict[tuple[int, int], str]):
        self.levels: list[tuple[int, list[str]]] = []
        nodes, level = leaves, 0
        while n > 1:
            hi = lo + len(nodes)
            begin, end = lo // ARITY * ARITY, min(n, -(-hi // ARITY) * ARITY)
            nodes = [lacking[level, i] for i in range(begin, lo)] + nodes + [lacking[level, i] for i in range(hi, end)]
            self.levels.append((begin, nodes))
            nodes = [H("".join(nodes[k : k + ARITY])) for k in range(0, len(nodes), ARITY)]
            lo, n, level = begin // ARITY, -(-n // ARITY), level + 1
        self.root = nodes[0]

    def proof(self, i: int) -> list[tuple[list[str], int]]:
        """For each level up to the root: the run that holds the node above leaf i, and its place there."""
        out = []
        for begin, nodes in self.levels:
            at = i // ARITY * ARITY - begin
            out.append((nodes[at : at + ARITY], i % ARITY))
            i //= ARITY
        return out


def fold(leaf: str, proof: list[tuple[list[str], int]]) -> str:
    for run, k in proof:
        leaf = H("".join([*run[:k], leaf, *run[k + 1 :]]))
    return leaf


def grown(work: Scratch, leaves: DataFrame, most: int, name: str) -> DataFrame | None:
    """The interior nodes (NODES) of all trees of leaves (tree, idx, digest, n); most: the largest n. None if there are none."""
    base, out, partitions = 0, None, int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    wide = ARITY**STRIDE

    def climb(key: tuple, rows: pa.Table) -> pa.Table:
        tree, chunk, level = key[0].as_py(), key[1].as_py(), key[2].as_py()
        n = rows.column("n")[0].as_py()
        count, first, got = -(-n // ARITY**level), chunk * wide, []
        nodes = [d.hex() for _, d in sorted(zip(rows.column("idx").to_pylist(), rows.column("digest").to_pylist(), strict=True))]
        for k in range(level + 1, level + STRIDE + 1):
            if count == 1:
                break
            nodes = [H("".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]
            count, first = -(-count // ARITY), first // ARITY
            got += [(tree, k, first + i, bytes.fromhex(d), n, count == 1) for i, d in enumerate(nodes)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=["tree", "level", "idx", "digest", "n", "top"])

    now = leaves.where("n > 1").select("tree", F.lit(0).alias("level"), "idx", "digest", "n")
    while most > 1:
        chunk = F.expr(f"idx div {wide}").alias("chunk")
        made = work.keep(now.select("*", chunk).repartition(partitions, "tree", "chunk", "level").groupBy("tree", "chunk", "level").applyInArrow(climb, NODES), f"{name}-{base}")
        out = made if out is None else out.unionByName(made)
        base, most = base + STRIDE, -(-most // wide)
        now = made.where((F.col("level") == base) & ~F.col("top")).drop("top")
    return out


def ranked(work: Scratch, sources: DataFrame) -> DataFrame:
    """The rows of sources, one for each, with their rank (tree) by source: null first, then bytewise."""
    many = -(-sources.count() // SOURCES) or 1
    dealt = work.keep(sources.repartitionByRange(many, F.asc_nulls_first("source")).withColumn("slice", F.spark_partition_id()), "sources")
    before = dealt.groupBy("slice").count().select("slice", (F.sum("count").over(W.orderBy("slice")) - F.col("count")).alias("before"))
    place = F.row_number().over(W.partitionBy("slice").orderBy(F.asc_nulls_first("source"))) - 1
    return dealt.join(F.broadcast(before), "slice").withColumn("tree", F.col("before") + place).drop("slice", "before")  # a row for SOURCES sources


def prove(docs: DataFrame) -> DataFrame:
    """PROVED for documents (doc_id, source, lang, n_chars, text)."""
    spark = docs.sparkSession
    ship(spark)
    work, partitions = Scratch(spark, "merkle"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = work.keep(leaves_of(docs), "raw")
    count = raw.count()
    if not count:
        return spark.createDataFrame([], PROVED)
    order = (F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"))
    dealt = raw.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(-(-count // LEAVES), *order, F.asc("spread"))  # spread: equal rows can be cut apart
    dealt = work.keep(dealt.select(F.spark_partition_id().alias("part"), "source", "doc_id", "leaf", "tampered"), "dealt")

    held = dealt.groupBy("part", "source").agg(F.count("*").alias("held"))
    held = work.keep(held.select("*", (F.sum("held").over(W.partitionBy("source").orderBy("part")) - F.col("held")).alias("lo")), "held")
    trees = ranked(work, held.groupBy("source").agg(F.sum("held").alias("n")))
    ranges = held.alias("h").join(trees.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source"))).select("part", "h.source", "tree", "lo", "held", "n")
    ranges = work.keep(ranges, "ranges")
    sources, most = ranges.select(F.max("tree") + 1, F.max("n")).first()

    placed = dealt.alias("d").join(ranges.alias("r"), (F.col("d.part") == F.col("r.part")) & F.col("d.source").eqNullSafe(F.col("r.source")))
    within = F.row_number().over(W.partitionBy("d.part", "tree").orderBy(F.asc_nulls_first("doc_id"), "leaf"))
    leaves = work.keep(placed.select("d.part", "tree", (F.col("lo") + within - 1).alias("idx"), "n", "doc_id", F.col("leaf").alias("digest"), "tampered"), "leaves")

    nodes = leaves.select("tree", F.lit(0).alias("level"), "idx", "digest")
    subroots = leaves.where("n = 1").select("tree", "digest")
    inner = grown(work, leaves, most, "inner")
    if inner is not None:
        nodes, subroots = nodes.unionByName(inner.select(*nodes.columns)), subroots.unionByName(inner.where("top").select("tree", "digest"))
    over = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(sources).cast("long").alias("n"))
    upper = grown(work, over, sources, "upper")
    nodes = nodes.unionByName(over.select("tree", F.lit(0).alias("level"), "idx", "digest"))
    if upper is not None:
        nodes = nodes.unionByName(upper.select(*nodes.columns))

    def lacking(key: tuple, rows: pa.Table) -> pa.Table:
        own = [(r["tree"], r["lo"], r["lo"] + r["held"], r["n"]) for r in rows.to_pylist()]
        own.append((TOP, min(r[0] for r in own), max(r[0] for r in own) + 1, sources))  # a range of leaves has each source between its ends
        got = [(tree, level, i) for tree, lo, hi, n in own for level, i in missing(lo, hi, n)]
        tree, level, i = map(list, zip(*got)) if got else ([], [], [])
        return pa.table({"part": pa.array([key[0].as_py()] * len(got), pa.int32()), "tree": pa.array(tree, pa.int64()), "level": pa.array(level, pa.int32()), "idx": pa.array(i, pa.int64())})

    wanted = ranges.groupBy("part").applyInArrow(lacking, "part int, tree long, level int, idx long")
    fetched = wanted.join(nodes, ["tree", "level", "idx"]).toDF("tree", "level", "idx", "part", "digest")

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        given: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, i, d in zip(*[right.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")], strict=True):
            given.setdefault(tree, {})[level, i] = d.hex()
        mine: dict[int, list[tuple]] = {}
        for tree, *row in zip(*[left.column(c).to_pylist() for c in ("tree", "idx", "digest", "tampered", "doc_id", "n")], strict=True):
            mine.setdefault(tree, []).append(row)
        branches = {}
        for tree in sorted(mine):
            mine[tree].sort(key=lambda r: r[0])
            branches[tree] = Branch(mine[tree][0][0], [r[1].hex() for r in mine[tree]], mine[tree][0][4], given.get(tree, {}))
        top = Branch(min(mine, default=0), [b.root for b in branches.values()], sources, given.get(TOP, {})) if mine else None
        out: list[tuple] = []
        for tree, branch in branches.items():
            above = top.proof(tree)
            for i, digest, tampered, doc_id, _ in mine[tree]:
                proof = branch.proof(i) + above
                folded = fold((tampered or digest).hex(), proof)
                out.append((doc_id, digest.hex(), branch.root, top.root, H("".join([d for run, k in proof for d in (*run[:k], *run[k + 1 :])])), folded, folded == top.root))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        cols = list(zip(*out)) if out else [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in PROVED.split(", ")])

    return leaves.repartition(partitions, "part").groupBy("part").cogroup(fetched.repartition(partitions, "part").groupBy("part")).applyInArrow(expand, PROVED)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prove(table(spark, sf_dir, "documents"))


def _levels(name: str, depth: int) -> str:
    """SQL that carries name_0 (tree, i, h) and path_0 (.., tree, i, f, proof) up depth levels: the runs, then what is above each row."""
    out = []
    for k in range(depth):
        out.append(f"""
{name}_r{k} as materialized (select tree, i // 3 as g, list(h order by i) as hs, any_value(n) as n from (select *, count(*) over (partition by tree) as n from {name}_{k}) group by tree, i // 3),
{name}_{k + 1} as materialized (select tree, g as i, case when n = 1 then hs[1] else sha256(list_aggregate(hs, 'string_agg', '')) end as h from {name}_r{k}),
{name}_p{k + 1} as materialized (select p.* replace (i // 3 as i,
    case when n = 1 then f else sha256(list_aggregate([case when i % 3 = j then f else hs[j + 1] end for j in range(len(hs))], 'string_agg', '')) end as f,
    case when n = 1 then proof else proof || coalesce(list_aggregate([hs[j + 1] for j in range(len(hs)) if i % 3 <> j], 'string_agg', ''), '') end as proof) from {name}_p{k} p join {name}_r{k} r on p.tree = r.tree and p.i // 3 = r.g),""")
    return "".join(out)


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else octet_length(encode({c}::varchar)) || ':' || {c}::varchar end"


#: Trees of up to 3 ** 12 rows and 3 ** 6 sources, which is what the small tables have; crc32 is computed bit by bit.
OP11_SQL = f"""
with d as (select *, doc_id::varchar as id, {" || ".join(_field(c) for c in FIELDS[:4])} as head from documents),
e as materialized (select doc_id, source, sha256(head || {_field("text")}) as leaf, sha256(head || {_field("replace(text, chr(10), '')")}) as bare,
    list_reduce(list_prepend(4294967295::bigint, range(8 * len(id))), lambda c, k: xor((xor(c, case when k % 8 = 0 then ascii(id[k // 8 + 1]) else 0 end)) >> 1,
        case when xor(c, case when k % 8 = 0 then ascii(id[k // 8 + 1]) else 0 end) % 2 = 1 then 3988292384::bigint else 0 end)) as crc from d),
l as materialized (select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, case when xor(crc, 4294967295) % 2 = 0 then bare else leaf end as f from e),
s_0 as materialized (select tree, i, leaf as h from l), s_p0 as materialized (select doc_id, leaf, tree, i, f, '' as proof from l),{_levels("s", 12)}
u_0 as materialized (select -1 as tree, tree as i, h from s_12), u_p0 as materialized (select p.* replace (-1 as tree, p.tree as i), h as subroot from s_p12 p join s_12 s on s.tree = p.tree),{_levels("u", 6)}
x as (select h as root from u_6)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified from u_p6, x"""
