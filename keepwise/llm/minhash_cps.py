"""MinHash near-dedup by a chosen-path set-similarity join.

Documents with the same shingle set are one class. Every class has a sketch of
minwise values. A tree node is a set of classes that agree on the minwise tokens
chosen along a path: the node picks one or two of the sketch's coordinates (by a
hash of its own key), and sends a class to one child per picked coordinate, named
by the class's value there. Nodes of at most ``NODE`` classes are compared
exhaustively; larger ones branch on, down to the last of ``BRANCHES``. ``TREES`` independent
trees bring the chance to miss a pair at similarity 0.75 to about 1e-5.

Inside a node all members are compared by sketch; what looks similar is confirmed
on full shingle sets. Links only matter as far as they join components, so this is
done in rounds: (1) every class is confirmed against the one it resembles most and
components are formed; (2) the same in every node (or block of a large one) that still holds
several components, with the most similar class of another component; (3) in the nodes still
mixed, all resembling pairs across components are confirmed inside the node, each
only if its pair of blocks has not joined the two by then. Pairs inside one component are never confirmed, which keeps a group
of n copies at about n confirmations.

A node that is still larger than ``NODE`` at the last level (a large group of near
copies, or of texts with a passage in common) is dealt into blocks. In rounds 1 and 2 a
block is compared for itself; in round 1 it also holds the node's smallest class. In
round 3 a node with very many classes outside its largest component branches on first,
and what stays large is dealt into pairs of blocks: each pair of classes across
components meets once, and no group of a task holds more than two blocks. The cost of
that still grows with the square of a node that branching does not make smaller.

Edge cases: null, empty or blank text has an empty set and links with nothing;
under five words the whole sequence is the one shingle; repeated rows are one
class, and rows of one doc_id with different texts are separate documents of that
id; a null doc_id takes part but names a component only if all its ids are null;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import map_columns, materialize, rows_of, whole_groups
from keepwise.llm.graph import components, joined
from keepwise.llm.shingles import fingerprint, intersection, mix, shingle_sets
from keepwise.llm.sieve import SIEVE, Sieve

COORDS = 64
TREES, NODE = 6, 128
BRANCHES = (2, 2, 1)   # children of a node, by level: no class is in more than 24 nodes at a time
DEALS = 64            # a mixed node that takes more pairs of blocks than this branches on in round 3
DEEPER = (6, *[2] * 15)   # its children, by further level
STUCK, SHRINK = 2, 0.7    # it stops where two levels each left more than this share of a node
PERCENT = 75          # 100 * intersection >= PERCENT * union
SKETCH_FLOOR = 34     # of 64 coordinates: a pair at 0.75 shows fewer with probability 5e-5
_RNG = np.random.Generator(np.random.PCG64(40_1729))
_KEY = _RNG.integers(1, 2**64 - 1, COORDS, dtype=np.uint64)
_ODD = _RNG.integers(1, 2**64 - 1, COORDS, dtype=np.uint64) | np.uint64(1)
BATCH = 512


def sketch_of(s: np.ndarray) -> bytes:
    low = np.full(COORDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        part = (s[None, at:at + 4096] ^ _KEY[:, None]) * _ODD[:, None]
        low = np.minimum(low, part.min(axis=1))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def low_bytes(sketch: bytes) -> bytes:
    """A byte of every coordinate: what members of a node are compared by. Equal coordinates
    have equal bytes, so no resembling pair shows less agreement than by the whole values."""
    return sketch[::4]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, fp_a, fp_b, sketch; the last three null without words."""
    def run(frames: Iterator[dict]) -> Iterator[dict]:
        for rows in frames:
            found = [(len(s), *fingerprint(s), sketch_of(s)) if len(s) else (0, None, None, None) for s in shingle_sets(rows["text"])]
            yield {"doc_id": rows["doc_id"], "key": rows["key"], **dict(zip(("n_shingles", "fp_a", "fp_b", "sketch"), zip(*found)))}

    return map_columns(_keyed(docs), run, "doc_id long, key long, n_shingles long, fp_a long, fp_b long, sketch binary", BATCH)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text"))


def _sketch_matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u4").reshape(-1, COORDS)


def _short_matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, COORDS)


def _shortened(classes: DataFrame) -> DataFrame:
    """(cls, short): the classes' sketches as :func:`low_bytes`."""
    def run(frames):
        for rows in frames:
            yield {"cls": rows["cls"], "short": [low_bytes(x) for x in rows["sketch"]]}

    return materialize(map_columns(classes.select("cls", "sketch"), run, "cls long, short binary"), "cps-short")


def _child(pick: np.ndarray, sketch: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Key of the child for the picked coordinates' values under a node hash."""
    value = sketch[np.arange(len(sketch)), pick].astype(np.uint64)
    return mix(h ^ mix(value + pick.astype(np.uint64) * np.uint64(2**33)))


def _spread(cls: np.ndarray, keys: list[np.ndarray]) -> dict:
    return {"cls": np.tile(cls, len(keys)), "node": np.concatenate(keys).view(np.int64)}


def _roots(classes: DataFrame) -> DataFrame:
    """(cls, node) of the first level: the children of each tree's root, every one by a coordinate of its own."""
    def run(frames):
        for rows in frames:
            m = _sketch_matrix(rows["sketch"])
            yield _spread(rows["cls"], [_child(np.full(len(m), 5 * k % COORDS), m, np.full(len(m), k + 1, dtype=np.uint64))
                                        for k in range(TREES * BRANCHES[0])])

    return map_columns(classes.select("cls", "sketch"), run, "cls long, node long")


def _branch(members: DataFrame, level: int) -> DataFrame:
    """(cls, node) of the children of every member's node: the node's hash picks the coordinates."""
    picks = BRANCHES[level]
    share = COORDS // picks

    def run(frames):
        for rows in frames:
            m, node, keys = _sketch_matrix(rows["sketch"]), rows["node"].view(np.uint64), []
            for k in range(picks):
                h = mix(node + np.uint64(level * picks + k + 1))
                keys.append(_child((h % np.uint64(share)).astype(np.int64) + k * share, m, h))
            yield _spread(rows["cls"], keys)

    return map_columns(members.select("cls", "node", "sketch"), run, "cls long, node long")


def _unused(h: np.ndarray, used: np.ndarray) -> np.ndarray:
    """A coordinate per row, by its hash, that is not among the bits of ``used``."""
    while True:
        pick = h % np.uint64(COORDS)
        taken = (used >> pick) & np.uint64(1) == 1
        if not taken.any():
            return pick
        h = np.where(taken, mix(h + np.uint64(1)), h)


def _deeper(members: DataFrame, picks: int) -> DataFrame:
    """cls, node, component, used, stuck, above (the parent's size) of the children
    of every member's node, each by a coordinate that the path has not used."""
    def run(frames):
        for rows in frames:
            m, node, path, keys, used = _sketch_matrix(rows["sketch"]), rows["node"].view(np.uint64), rows["used"].view(np.uint64), [], []
            taken = path
            for k in range(picks):
                h = mix(node + np.uint64(k + 1))
                pick = _unused(h, taken)
                bit = np.uint64(1) << pick
                taken = taken | bit
                keys.append(_child(pick.astype(np.int64), m, h))
                used.append(path | bit)
            yield {**_spread(rows["cls"], keys), "used": np.concatenate(used).view(np.int64),
                   **{n: np.tile(rows[c], picks) for n, c in (("component", "component"), ("stuck", "stuck"), ("above", "size"))}}

    return map_columns(members.select("cls", "node", "component", "used", "stuck", "size", "sketch"), run,
                       "cls long, node long, component long, used long, stuck int, above long")


def leaves(classes: DataFrame) -> DataFrame:
    """(cls, node, size) of all leaf nodes with at least two members."""
    level, out = _roots(classes), []
    for depth in range(1, len(BRANCHES) + 1):
        level = materialize(level, "cps-level")
        sizes = materialize(level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "cps-sizes")
        sized = level.join(sizes, "node")
        if depth == len(BRANCHES):
            out.append(sized)
            break
        out.append(sized.where(F.col("size") <= NODE))
        large = sized.where(F.col("size") > NODE).select("cls", "node")
        level = _branch(large.join(classes.select("cls", "sketch"), "cls"), depth)
    leaf = out[0]
    for x in out[1:]:
        leaf = leaf.unionByName(x)
    return materialize(leaf.select("cls", "node", "size"), "cps-leaves")


def _resembling(rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs (i < j, every row at most once on each side) of the same block whose
    sketches agree often enough, and how often. The rows are sorted by block, so
    partners are compared at distance 1, 2, ..."""
    group, m = _blocks(rows), _short_matrix(rows["short"])
    i = np.arange(len(m))
    for d in range(1, len(m)):
        i = i[i + d < len(m)]
        i = i[group[i] == group[i + d]]
        if not len(i):
            return
        for part in np.array_split(i, 1 + len(i) // 50_000):
            agree = (m[part] == m[part + d]).sum(axis=1)
            hit = agree >= SKETCH_FLOOR
            if hit.any():
                yield part[hit], part[hit] + d, agree[hit]


def _blocks(rows: dict) -> np.ndarray:
    """A running number per block of sorted rows."""
    node, block = rows["node"], rows["block"]
    return np.concatenate([[0], np.cumsum((node[1:] != node[:-1]) | (block[1:] != block[:-1]))])


class _Best:
    """The partner of each row with the most agreement, the smallest class among equals."""

    def __init__(self, n: int):
        self.agree, self.cls = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)

    def offer(self, rows: np.ndarray, cls: np.ndarray, agree: np.ndarray) -> None:
        better = (agree > self.agree[rows]) | ((agree == self.agree[rows]) & (cls < self.cls[rows]))
        self.agree[rows[better]], self.cls[rows[better]] = agree[better], cls[better]


def _dealt(members: DataFrame, short: DataFrame) -> DataFrame:
    """With short sketches, blocks of one node next to each other, whole, in one task each."""
    return (members.join(short, "cls")
            .repartition("node", "block").sortWithinPartitions("node", "block", "cls"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _closest(leaf: DataFrame, short: DataFrame) -> DataFrame:
    """(a, b): each class with the one it resembles most in any node, and with the
    smallest class of a large node it is in if it resembles that."""
    blocks = F.ceil(F.col("size") / NODE).cast("int")
    large = F.col("size") > NODE
    own = leaf.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    low = materialize(leaf.where(large).groupBy("node", "size").agg(F.min("cls").alias("cls")), "cps-lead")
    lead = low.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("leads", F.lit(True))
    rows = (own.withColumn("leads", F.lit(False)).unionByName(lead.select("cls", "node", "size", "block", "leads"))
            .select("cls", "node", "block", "leads"))

    def run(frames):
        for rows in whole_groups(frames, ["node", "block"]):
            cls, leads, best = rows["cls"], rows["leads"], _Best(len(rows["cls"]))
            for i, j, agree in _resembling(rows):
                x = cls[i] != cls[j]
                best.offer(i[x], cls[j[x]], agree[x])
                best.offer(j[x], cls[i[x]], agree[x])
                to_lead = x & (leads[i] | leads[j])
                if to_lead.any():
                    a, b = np.where(leads[i], cls[j], cls[i])[to_lead], np.where(leads[i], cls[i], cls[j])[to_lead]
                    yield {"a": a, "b": b, "agree": np.zeros(len(a), dtype=np.int64)}
            hit = best.agree > 0
            yield {"a": cls[hit], "b": best.cls[hit], "agree": best.agree[hit]}

    found = map_columns(_dealt(rows, short), run, "a long, b long, agree long")
    top = found.groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("best"),
                                 F.min(F.when(F.col("agree") == 0, F.col("b"))).alias("lead"))
    both = top.select("a", F.explode(F.array("best", "lead")).alias("b")).where("b is not null")
    return materialize(_pairs(both), "cps-closest")


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows (cls, node, component, ...) of nodes that hold more than one component,
    with the node's size, its largest component ``main`` and how many classes that has."""
    counts = placed.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = materialize(counts.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"),
                                                   F.max(F.struct("n", "component")).alias("top")).where("k > 1")
                        .select("node", "size", F.col("top.component").alias("main"), F.col("top.n").alias("n_main")), "cps-mixed")
    return materialize(placed.join(mixed, "node"), "cps-rows")


def _placed(leaf: DataFrame, comp: DataFrame) -> DataFrame:
    known = comp.select(F.col("id").alias("cls"), "component")
    return materialize(leaf.join(known, "cls", "left").select("cls", "node", F.coalesce("component", "cls").alias("component")), "cps-placed")


def _narrowed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Mixed nodes, those that take many pairs of blocks replaced by their mixed
    descendants. Two children keep a pair's chance to stay together; nodes that hold
    a share of at most 0.7 of their parent cost fewer pairs than it, the others (near
    copies) are not branched on again and again."""
    rows, out = rows.withColumn("used", F.lit(0).cast("long")).withColumn("stuck", F.lit(0)), None
    main, outside = F.ceil(F.col("n_main") / NODE), F.ceil((F.col("size") - F.col("n_main")) / NODE)
    many = (F.col("size") > NODE) & (outside * (main + (outside + 1) / 2) > DEALS) & (F.col("stuck") < STUCK)
    for picks in DEEPER:
        done, wide = rows.where(~many), rows.where(many)
        out = done if out is None else out.unionByName(done)
        if wide.isEmpty():
            return out
        level = materialize(_deeper(wide.join(classes.select("cls", "sketch"), "cls"), picks), "cps-deeper")
        rows = _mixed(level).withColumn("stuck", F.col("stuck") + (F.col("size") > SHRINK * F.col("above")).cast("int")).drop("above")
    return out.unionByName(rows)


def _block_pairs(rows: DataFrame) -> DataFrame:
    """cls, node, block, component, right, own: mixed nodes dealt into pairs of blocks, so that
    two classes of different components meet in exactly one of a node's pairs.

    Blocks have about ``NODE`` classes, those of the largest component first. ``block``
    names the pair, ``right`` its second block, ``own`` the pair of a block with itself.
    A block of the largest component is paired with those of other classes only."""
    part = lambda n: F.ceil(n / NODE).cast("int")
    inside, large = F.col("component") == F.col("main"), F.col("size") > NODE
    n_in, n_out = part(F.col("n_main")), part(F.col("size") - F.col("n_main"))
    at = F.when(~large, 0).when(inside, F.pmod(F.xxhash64("cls"), n_in)).otherwise(n_in + F.pmod(F.xxhash64("cls"), n_out)).cast("int")
    others = F.when(~large, F.array(F.lit(0))).otherwise(F.sequence(F.when(inside, n_in).otherwise(F.lit(0)), n_in + n_out - 1))
    met = rows.select("cls", "node", "component", at.alias("at"), F.explode(others).alias("other"))
    pair = F.least("at", "other").cast("long") * 2**31 + F.greatest("at", "other")
    return met.select("cls", "node", pair.alias("block"), "component", (F.col("at") > F.col("other")).alias("right"),
                      (F.col("at") == F.col("other")).alias("own"))


def _meeting(rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs across components whose sketches agree often enough, each in the one pair of blocks it meets in."""
    c, m, own = rows["component"], _short_matrix(rows["short"]), rows["own"]
    if own.any():
        at = np.flatnonzero(own)
        for i, j, _ in _resembling(rows_of(rows, own)):
            i, j = at[i], at[j]
            x = c[i] != c[j]
            yield i[x], j[x]
    two = np.flatnonzero(~own)
    group = _blocks(rows)[two]
    for part in np.split(two, np.flatnonzero(np.diff(group)) + 1):
        left, right = part[~rows["right"][part]], part[rows["right"][part]]
        for some in np.array_split(left, 1 + len(left) // NODE):
            hit = (c[some][:, None] != c[right]) & ((m[some][:, None] == m[right]).sum(axis=2) >= SKETCH_FLOOR)
            i, j = np.nonzero(hit)
            yield some[i], right[j]


def _closest_across(leaf: DataFrame, short: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b): per node, each class with the class of another component it resembles most."""
    def run(frames):
        for rows in whole_groups(frames, ["node", "block"]):
            cls, c, best = rows["cls"], rows["component"], _Best(len(rows["cls"]))
            for i, j, agree in _resembling(rows):
                x = c[i] != c[j]
                best.offer(i[x], cls[j[x]], agree[x])
                best.offer(j[x], cls[i[x]], agree[x])
            hit = best.agree > 0
            yield {"a": cls[hit], "b": best.cls[hit]}

    blocks = F.ceil(F.col("size") / NODE).cast("int")   # the blocks of round 1
    rows = (_mixed(_placed(leaf, comp)).withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
            .select("cls", "node", "block", "component"))
    return materialize(_pairs(map_columns(_dealt(rows, short), run, "a long, b long")), "cps-across")


def _links_across(leaf: DataFrame, classes: DataFrame, short: DataFrame, comp: DataFrame, sets_for) -> DataFrame:
    """(a, b): links across components that meet in a node, as many as join them;
    ``sets_for`` gives the full sets of at least the classes (cls) it is asked for."""
    members = _block_pairs(_narrowed(_mixed(_placed(leaf, comp)), classes))

    def needed(frames):
        for rows in whole_groups(frames, ["node", "block"]):
            hit = np.zeros(len(rows["cls"]), dtype=bool)
            for i, j in _meeting(rows):
                hit[i] = hit[j] = True
            yield rows_of(rows, hit)

    def confirm(frames):
        for rows in whole_groups(frames, ["node", "block"]):
            cls, c, place, root = rows["cls"].tolist(), rows["component"].tolist(), _blocks(rows).tolist(), {}
            full = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]

            def find(k):
                while root.get(k, k) != k:
                    root[k] = root.get(root[k], root[k])
                    k = root[k]
                return k

            links = []
            for i, j in _meeting(rows):
                for x, y in zip(i.tolist(), j.tolist()):
                    p, q = find((place[x], c[x])), find((place[y], c[y]))   # what this block has joined
                    if p != q and similar(full[x], full[y]):
                        root[max(p, q)] = min(p, q)
                        links.append((cls[x], cls[y]))
            if links:
                yield dict(zip(("a", "b"), zip(*links)))

    schema = "cls long, node long, block long, component long, right boolean, own boolean, short binary"
    rows = materialize(map_columns(_dealt(members, short), needed, schema), "cps-needed")
    dealt = rows.join(sets_for(rows.select("cls")), "cls").repartition("node", "block").sortWithinPartitions("node", "block", "cls")
    return materialize(_pairs(map_columns(dealt, confirm, "a long, b long")), "cps-links")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = intersection(a, b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sifted(rows: DataFrame, wanted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not among ``names`` of ``wanted``: no wanted
    row is lost, and the join that follows takes out the rest. So texts nobody asked for are not shuffled."""
    return Sieve(wanted, names, SIEVE).marked(rows, keys, "_hit").where("_hit").drop("_hit")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, hashes): the full shingle sets of the wanted classes (cls, lead)."""
    def run(frames):
        for rows in frames:
            yield {"cls": rows["cls"], "hashes": [s.tobytes() for s in shingle_sets(rows["text"])]}

    lead = wanted.select("cls", F.coalesce("lead.doc_id", F.lit(0)).alias("lead_id"), F.col("lead.no_id").alias("lead_none"), F.col("lead.key").alias("lead_key"))
    rows = _keyed(docs).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "key", "text")
    rows = _sifted(rows, lead, ["id", "none", "key"], ["lead_id", "lead_none", "lead_key"])
    rows = rows.join(lead, (F.col("id") == F.col("lead_id")) & (F.col("none") == F.col("lead_none")) & (F.col("key") == F.col("lead_key")))
    found = map_columns(rows.select("cls", "text"), run, "cls long, hashes binary", BATCH)
    return found.groupBy("cls").agg(F.first("hashes").alias("hashes"))   # a row may stand there more than once


def _with_sets(sets: DataFrame, docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sets`` and those of the wanted classes (cls) that are not among them yet."""
    lacking = materialize(wanted.distinct().join(sets.select("cls"), "cls", "left_anti"), "cps-lacking")
    if lacking.isEmpty():
        return sets
    return sets.unionByName(materialize(_sets(docs, classes.join(lacking, "cls", "left_semi")), "cps-more-sets"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    def run(frames):
        for rows in frames:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(rows["sa"], rows["sb"])]
            yield rows_of({"a": rows["a"], "b": rows["b"]}, np.array(ok, dtype=bool))

    left = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("sb"))
    return map_columns(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), run, "a long, b long", BATCH)


def labelled(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, key, n_shingles, component_id and ``lead`` (doc_id and key of the one row that stands for its component)."""
    every = materialize(sketches(docs), "cps-sketches")
    # one class per distinct set, combined map-side: copies cost one row per task
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = materialize(every.where("n_shingles > 0").withColumn("row", F.monotonically_increasing_id())
                          .groupBy("fp_a", "fp_b")
                          .agg(F.min("row").alias("cls"), F.min(lead).alias("lead"), F.min("sketch").alias("sketch")), "cps-classes")
    leaf, short = leaves(classes), _shortened(classes)
    pairs = _closest(leaf, short)
    # full sets of what resembled a class in round 1; a class whose partners are all in other
    # blocks of its nodes comes up only later, so every round adds the sets it asks for
    sets = materialize(_sets(docs, classes.join(_ends(pairs), "cls", "left_semi")), "cps-sets")
    comp = components(_confirm(pairs, sets))
    across = _closest_across(leaf, short, comp)
    sets = _with_sets(sets, docs, classes, _ends(across))
    comp = joined(comp, _confirm(across, sets))
    comp = joined(comp, _links_across(leaf, classes, short, comp, lambda wanted: _with_sets(sets, docs, classes, wanted)))
    rooted = materialize(classes.drop("sketch").join(comp, F.col("cls") == F.col("id"), "left")
                         .select("fp_a", "fp_b", "lead", F.coalesce("component", "cls").alias("root")), "cps-rooted")
    heads = materialize(rooted.groupBy("root").agg(F.min("lead").alias("lead")), "cps-heads")
    label = materialize(rooted.drop("lead").join(heads, "root").select("fp_a", "fp_b", "lead"), "cps-labels")
    alone = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    return (every.drop("sketch").join(label, ["fp_a", "fp_b"], "left")
            .select("doc_id", "key", "n_shingles", F.coalesce("lead", alone).alias("lead"))
            .withColumn("component_id", F.col("lead.doc_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return labelled(docs).select("doc_id", "n_shingles", "component_id",
                                 F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``.

    Texts do not move for it: a row that stays and has no other alike in id and text is told by
    a sieve of all other keys. What that holds back and the kept keys may have is settled exactly:
    rows alike are reduced before the shuffle, by the very columns that meet the kept ones, none null."""
    names = ["_id", "_none", "_key"]
    key = lambda i, k: [F.coalesce(i, F.lit(0)).alias("_id"), i.isNull().alias("_none"), k.alias("_key")]
    stays = F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.key") == F.col("key"))
    keys = materialize(labelled(docs).select(*key(F.col("doc_id"), F.col("key")), stays.alias("stays")).groupBy(*names)
                       .agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "cps-keep")
    keep, others = keys.where("stays").select(*names), keys.where("NOT stays OR n > 1")
    whole = docs.select(F.struct("*").alias("row"), *key(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    marked = Sieve(others, names).marked(whole, names, "_other")
    held = Sieve(keep, names).marked(marked.where("_other"), names, "_kept").where("_kept")
    one = held.select("row", *names).dropDuplicates(names).join(keep, names, "left_semi")
    return marked.where("NOT _other").select("row.*").unionByName(one.select("row.*"))
