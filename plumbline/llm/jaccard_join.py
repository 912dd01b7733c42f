"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

The incidence matrix (a row per distinct set of shingles, a column per shingle) is cut into blocks of columns. A block
counts in how many sets each of its shingles is and hands back, to the block of rows of a set, only the shingles that
some other set has too: no other entry adds to a product. A row whose shared entries can't reach the bound for its size
is dropped. The remaining rows are compared by their rarest entries: two sets over the threshold share one among the
first ``n - ceil(t n) + 1`` in the order (count, shingle), at a place that still leaves room for the overlap that both
sizes ask for. For the pairs that pass, blocks of rows are multiplied and the overlap counted in full.

Pairs inside one component aren't needed: first every row meets one row of each of its columns (a star, linear in the
column), linked rows become components, and afterwards only pairs across components meet, in tiles that return links
which join what they found linked, fewer than they have rows, and never lists of pairs.

Shingles are 64-bit hashes, of which 48 bits travel within a block of columns, and a set is named by the 64-bit hash of
its shingles; different texts could be confused with a chance of about n squared / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components, star_forest
from plumbline.llm.pretokens import mixed
from plumbline.llm.shared import forgotten, kept
from plumbline.llm.words import BLANKS, distinct_per_text, hashed_words, row_slices, shingles

#: Text bytes behind one block of columns, and entries in one block of a product.
COLUMN_BLOCK, ROW_BLOCK = 12 << 20, 2 << 20
#: Text bytes whose entries one task cuts at once.
SLICE = 4 << 20
#: Rows (of a few numbers) that are sent to all tasks at most; larger tables are shuffled.
SENT = 1 << 17
#: Cells of a product that are counted at once.
CELLS = 1 << 21

BLOCKS = "key int, ids array<long>, sizes binary, counts binary, tokens binary, dfs binary"
ARROW = pa.schema(
    [("key", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("dfs", pa.binary())]
)


def _cut(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that are consecutive parts of ``data``."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize * (data.shape[1] if data.ndim > 1 else 1)).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]
    )


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def set_names(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set of shingles."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    return mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def incidence(docs: DataFrame, width: int, blocks: int) -> DataFrame:
    """Entries of the matrix by block of columns (key >= 0), and the documents with their sets (key < 0).

    A task sends a set once, however many copies of a document it reads.
    """

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in row_slices(whole, 1, SLICE)):
            values, bounds = distinct_per_text(*shingles(*hashed_words(batch.column(1), BLANKS, True), width))
            sizes = np.diff(bounds)
            names = set_names(values, bounds)
            key = -1 - int(names[0] % np.uint64(blocks)) if len(names) else -1
            empty = pa.array([b""], pa.binary())
            ids = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), batch.column(0))
            counts = _cut(names, np.array([0, len(names)]))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), ids, _cut(sizes.astype(np.int32), np.array([0, len(names)])), counts, empty, empty], schema=ARROW)
            fresh = np.zeros(len(names), bool)
            fresh[np.unique(names, return_index=True)[1]] = True
            fresh &= (sizes > 0) & ~np.isin(names, np.fromiter(seen, np.uint64, len(seen)))
            seen.update(names[fresh].tolist())
            rows = np.flatnonzero(fresh)
            if not len(rows):
                continue
            row = np.repeat(np.arange(len(rows)), sizes[rows])
            values = values[np.repeat(fresh, sizes)]
            block = ((values >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")
            block, row, values = block[order], row[order], values[order]
            first = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (row[1:] != row[:-1])))
            counts = np.diff(np.append(first, len(values)))
            bytes6 = values.view(np.uint8).reshape(-1, 8)[:, :6]
            keys = np.unique(block)
            at_set = np.append(np.searchsorted(block[first], keys), len(first))
            at_token = np.append(np.searchsorted(block, keys), len(values))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.astype(np.int32)), _lists(names[rows][row[first]], at_set), _cut(sizes[rows][row[first]].astype(np.int32), at_set),
                    _cut(counts.astype(np.int32), at_set), _cut(bytes6, at_token), pa.array([b""] * len(keys), pa.binary()),
                ],
                schema=ARROW,
            )

    return docs.select("ref", "text").mapInArrow(entries, BLOCKS)


def shared_entries(matrix: DataFrame, row_blocks: int) -> DataFrame:
    """Of every block of columns the shingles that two or more sets have, with their counts, by block of rows.

    Blocks of documents (key < 0) pass unchanged.
    """

    def count(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        if key < 0:
            return table
        raw = _joined(table.column("tokens"), np.uint8).reshape(-1, 6)
        tokens = np.zeros((len(raw), 8), np.uint8)
        tokens[:, :6] = raw
        tokens = tokens.view(np.uint64).ravel()
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        many = np.append(tokens[1:] == tokens[:-1], False)
        many[1:] |= many[:-1].copy()
        order, tokens = order[many], tokens[many]
        row = np.repeat(np.arange(len(counts := _joined(table.column("counts"), np.int32)), dtype=np.int32), counts)[order]
        names, sizes = _ids(table.column("ids"))[row], _joined(table.column("sizes"), np.int32)[row]
        order = np.lexsort((names, tokens))
        tokens, names, sizes = tokens[order], names[order], sizes[order]
        if len(tokens):
            new = np.append(True, (tokens[1:] != tokens[:-1]) | (names[1:] != names[:-1]))
            tokens, names, sizes = tokens[new], names[new], sizes[new]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
        df = np.diff(np.append(first, len(tokens)))
        df = np.repeat(df, df)
        keep = df > 1
        tokens, names, sizes, df = tokens[keep], names[keep], sizes[keep], df[keep]
        tokens = tokens | np.uint64(key) << np.uint64(48)
        block = (names % np.uint64(row_blocks)).astype(np.int64)
        order = np.lexsort((names, block))
        tokens, names, sizes, df, block = tokens[order], names[order], sizes[order], df[order], block[order]
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(names)))
        keys = np.unique(block)
        at_set = np.append(np.searchsorted(block[first], keys), len(first))
        at_token = np.append(np.searchsorted(block, keys), len(block))
        return pa.Table.from_arrays(
            [
                pa.array(keys.astype(np.int32)), _lists(names[first], at_set), _cut(sizes[first].astype(np.int32), at_set),
                _cut(counts.astype(np.int32), at_set), _cut(tokens, at_token), _cut(df.astype(np.int32), at_token),
            ],
            schema=ARROW,
        )

    return matrix.groupBy("key").applyInArrow(count, BLOCKS)


SETS = "name long, n int, alone int, tokens binary"


def candidate_sets(shared: DataFrame, percent: int) -> DataFrame:
    """Rows that can reach the threshold with some other: name, n, entries that no other set has, the others by rarity."""

    def rows(table: pa.Table) -> pa.Table:
        counts = _joined(table.column("counts"), np.int32)
        names, sizes = np.repeat(_ids(table.column("ids")), counts), np.repeat(_joined(table.column("sizes"), np.int32), counts)
        tokens, dfs = _joined(table.column("tokens"), np.uint64), _joined(table.column("dfs"), np.int32)
        order = np.lexsort((tokens, dfs, names))
        names, sizes, tokens = names[order], sizes[order], tokens[order]
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        have, n = np.diff(np.append(first, len(names))), sizes[first]
        able = 100 * have.astype(np.int64) >= percent * n.astype(np.int64)
        tokens = tokens[np.repeat(able, have)]
        ends = np.concatenate([[0], np.cumsum(have[able])])
        return pa.Table.from_arrays(
            [pa.array(names[first][able].view(np.int64)), pa.array(n[able].astype(np.int32)), pa.array((n - have)[able].astype(np.int32)), _cut(tokens, ends)],
            schema=pa.schema([("name", pa.int64()), ("n", pa.int32()), ("alone", pa.int32()), ("tokens", pa.binary())]),
        )

    return shared.where("key >= 0").groupBy("key").applyInArrow(rows, SETS)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, name, n, place): the first shared entries of every set, as far as a partner must share one of them."""

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n, alone = (batch.column(k).to_numpy().astype(np.int64) for k in range(3))
            tokens = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            want = np.maximum(n + (-percent * n) // 100 + 1 - alone, 0)
            tokens = [t[:w] for t, w in zip(tokens, want.tolist())]
            got = np.fromiter(map(len, tokens), np.int64, len(tokens))
            place = np.arange(got.sum()) - np.repeat(np.cumsum(got) - got - alone, got)
            flat = np.concatenate([*tokens, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (flat, np.repeat(names, got), np.repeat(n, got), place)], ["token", "name", "n", "place"])

    return sets.mapInArrow(first, "token long, name long, n long, place long")


def _room(percent: int):
    """The sizes and the places of a common first entry leave room for the overlap that the threshold asks for."""
    n, m = F.col("n"), F.col("m")
    room = F.least(n - F.col("place"), m - F.col("spot"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * room >= percent * (n + m))


def sent(rows: DataFrame) -> DataFrame:
    """A stored table marked for broadcast if its counted rows are few, else as it is."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def products(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, n, m) whose overlap, counted in full, reaches the threshold.

    Pairs are put into blocks by x, so a y that many x meet is sent once to each block.
    """
    pairs = kept(pairs, "pairs", 4)
    entries = pairs.agg(F.sum(F.col("n") + F.col("m"))).first()[0]
    if not entries:
        return pairs.select("x", "y")
    turned = pairs.select("x", "y", F.pmod(F.xxhash64("x"), F.lit(-(-int(entries) // ROW_BLOCK))).alias("block"))
    need = kept(turned.select(F.col("block").alias("tile"), F.explode(F.array("x", "y")).alias("name")).distinct(), "needed", 4)
    rows = sent(need).join(sets.select("name", "n", "tokens"), "name")

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("name").to_numpy()
        tokens = [np.frombuffer(t, np.uint64) for t in right.column("tokens").to_pylist()]
        order = np.argsort(names)
        at = {c: order[np.searchsorted(names, left.column(c).to_numpy(), sorter=order)] for c in "xy"}
        n, lengths = right.column("n").to_numpy().astype(np.int64), np.fromiter(map(len, tokens), np.int64, len(tokens))
        mark = mixed(np.arange(len(names), dtype=np.uint64))
        columns = np.unique(at["y"])
        cells = np.sort(np.concatenate([mixed(tokens[k] ^ mark[k]) for k in columns]))
        overlap = np.zeros(left.num_rows, np.int64)
        ends = np.cumsum(lengths[at["x"]])
        for part in np.split(np.arange(left.num_rows), np.flatnonzero(np.diff(ends >> 19)) + 1):
            if not len(part):
                continue
            flat = np.concatenate([tokens[k] for k in at["x"][part]])
            pair = np.repeat(part, lengths[at["x"][part]])
            want = mixed(flat ^ mark[at["y"][pair]])
            found = np.searchsorted(cells, want)
            overlap += np.bincount(pair[cells[np.minimum(found, len(cells) - 1)] == want], minlength=left.num_rows)
        linked = (100 + percent) * overlap >= percent * (n[at["x"]] + n[at["y"]])
        return left.select(["x", "y"]).filter(pa.array(linked))

    return turned.groupBy("block").cogroup(rows.groupBy("tile")).applyInArrow(multiply, "x long, y long")


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """The sparse product of two blocks of the incidence matrix: common entries of every row with every column.

    Comes in bands of columns, each with its first column, of ``CELLS`` cells and entries or so.
    """
    tokens = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(t) for t in rows])
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    known, first, count = np.unique(tokens[order], return_index=True, return_counts=True)
    step = max(1, CELLS // max(1, len(tokens)))
    for k in range(0, len(columns), step):
        part = columns[k : k + step]
        flat, column = np.concatenate(part), np.repeat(np.arange(len(part)), [len(t) for t in part])
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        at, column = at[hit], column[hit]
        n = count[at]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cell = owner[np.repeat(first[at], n) + inner] * len(part) + np.repeat(column, n)
        yield k, np.bincount(cell, minlength=len(rows) * len(part)).reshape(len(rows), -1)


def across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between components, each named by its smallest row, that join all components with linked rows.

    In a column the rows outside its largest component meet all its rows. Columns with the same largest component go
    together: its rows and those outside are cut into blocks by their entries, and the blocks are multiplied. Pairs are
    never listed, so a large component costs its rows times the few outside it, in tiles of bounded size; a task returns fewer
    links than it has components.
    """
    sizes = rows.groupBy("token", "component").count().groupBy("token")
    largest = sizes.agg(F.max(F.struct("count", "component")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    largest = kept(largest.select("token", F.col("top.component").alias("main")), "largest", 4)
    members = kept(rows.join(largest, "token").select("main", "name", "n", "component").distinct(), "members", 4)
    outside = F.col("component") != F.col("main")
    cuts = members.groupBy("main").agg(F.sum(F.when(outside, F.col("n"))).alias("x"), F.sum("n").alias("y"))
    parts = [F.ceil(F.col(c) / F.lit(limit)).cast("int").alias(f"{c}s") for c, limit in (("x", ROW_BLOCK // 8), ("y", ROW_BLOCK // 2))]
    members = members.join(kept(cuts.select("main", *parts), "cuts", 8), "main")
    here = lambda count: F.pmod(F.xxhash64("name"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    x = members.where(outside).select("main", "name", "component", here("xs").alias("xb"), every("ys").alias("yb"))
    y = members.select("main", "name", "component", every("xs").alias("xb"), here("ys").alias("yb"))
    tiles = kept(x.withColumn("side", F.lit(0)).unionByName(y.withColumn("side", F.lit(1))), "tiles", 4)
    groups = max(1, tiles.count() // 1024)
    tiles = sent(tiles).join(sets.select("name", "n", "tokens"), "name")
    tiles = tiles.withColumn("tile", F.xxhash64("main", "xb", "yb")).withColumn("group", F.pmod("tile", F.lit(groups)))

    def multiply(table: pa.Table) -> pa.Table:
        tile, side, names, component, n = (table.column(c).to_numpy() for c in ("tile", "side", "name", "component", "n"))
        tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        order = np.lexsort((side, tile))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for part in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            own, other = part[side[part] == 0], part[side[part] == 1]
            if not len(own) or not len(other):
                continue
            for k, common in overlaps([tokens[k] for k in own], [tokens[k] for k in other]):
                band = other[k : k + common.shape[1]]
                size = n[own].astype(np.int64)[:, None] + n[band].astype(np.int64)[None, :]
                linked = ((100 + percent) * common >= percent * size) & (component[own][:, None] != component[band][None, :])
                i, j = np.nonzero(linked)
                found.append(star_forest(component[own[i]], component[band[j]]))
        x, y = star_forest(*(np.concatenate(ends) for ends in zip(*found)))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return tiles.groupBy("group").applyInArrow(multiply, "x long, y long")


def linked_sets(sets: DataFrame, percent: int, stars: int) -> DataFrame:
    """(node, component) of the sets that have a link."""
    first = kept(prefixes(sets, percent), "prefixes")
    links = named = None
    for turn in range(stars + 1):
        rows = first.withColumn("component", F.col("name"))
        if named is not None:
            rows = first.join(named.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
            rows = kept(rows, "columns", 4)
        if turn < stars:
            # a star: every row of a column meets one row of it
            hub = F.struct(F.xxhash64("name", F.lit(turn)), F.col("name").alias("y"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("component").alias("c"))
            hubs = rows.groupBy("token").agg(F.min(hub).alias("h"), F.min("component").alias("a"), F.max("component").alias("b"))
            hubs = kept(hubs.where("a != b").select("token", "h.y", "h.m", "h.spot", "h.c"), "hubs", 4)
            pairs = rows.join(hubs, "token").where((F.col("component") != F.col("c")) & _room(percent))
            found = products(pairs.select(F.col("name").alias("x"), "y", "n", "m").distinct(), sets, percent)
        else:
            found = across(rows, sets, percent)
        links = found if links is None else links.unionByName(found)
        links = kept(links, "linked", 8)
        named = components(links)
    forgotten(first)
    return named


def _document_rows(docs: DataFrame, width: int, percent: int, stars: int) -> DataFrame:
    """``docs`` (ref, text) as (ref, n_shingles, name, component): the sets, and null for a set without a link."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // COLUMN_BLOCK))
    shared = kept(shared_entries(incidence(docs, width, blocks), blocks), "shared-entries")
    sets = kept(candidate_sets(shared, percent), "candidate-sets")

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, names = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in ((1, np.int32), (2, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.array(sizes.astype(np.int64)), pa.array(names)], ["ref", "n_shingles", "name"])

    rows = shared.where("key < 0").select("ids", "sizes", "counts").mapInArrow(unpack, "ref long, n_shingles long, name long")
    rows = kept(rows, "document-sets")
    forgotten(shared)
    named = linked_sets(sets, percent, stars)
    forgotten(sets)
    # the sets are told their component first: a set that many documents have is one row here
    known = rows.where("n_shingles > 0").select("name").distinct().join(named.withColumnRenamed("node", "name"), "name", "left")
    known = kept(known.withColumn("component", F.coalesce("component", "name")), "set-components", 8)
    return rows.join(known, "name", "left")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, stars: int = 1) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    The words of a text are runs of characters other than space and 09 to 0D, with A-Z lower-cased; its set is the
    distinct runs of ``width`` words, the whole sequence if it has fewer, and empty if it has none. Two rows are linked
    when 100 * intersection >= percent * union; component_id is the smallest doc_id that links reach, itself included.

    Empty and null texts have n_shingles 0 and link with nothing. Rows with a null doc_id link like others; they give
    their component no name, and it is null if nobody else does. Repeated rows are rows of their own in one component.
    An empty table gives no rows. Other columns are ignored. ``stars`` changes the work, never the result.
    """
    rows = _document_rows(docs.select(F.col("doc_id").cast("long").alias("ref"), "text"), width, percent, stars)
    rows = kept(rows, "document-components")
    lowest = kept(rows.where("n_shingles > 0").groupBy("component").agg(F.min("ref").alias("component_id")), "lowest", 8)
    rows = rows.join(lowest, "component", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("ref"))
    return rows.select(F.col("ref").alias("doc_id"), "n_shingles", own.alias("component_id"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 75, stars: int = 1) -> DataFrame:
    """One row of ``docs``, all columns, for each component: the one with the smallest doc_id (null last).

    Texts without words are kept, each doc_id once. Rows that agree in doc_id and text
    are one, the least by its other columns (as JSON).
    """
    row_key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))
    refs = docs.select(row_key.alias("ref"), F.col("doc_id").cast("long").alias("id"), "text")
    rows = _document_rows(refs.select("ref", "text"), width, percent, stars)
    rows = kept(rows, "document-components")
    ids = refs.select("ref", "id").distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "ref"))
    linked = rows.where("n_shingles > 0").select("ref", "component").distinct()
    stay = linked.join(ids, "ref").groupBy("component").agg(first.alias("first")).select(F.col("first.ref").alias("_ref"))
    stay = kept(stay.unionByName(rows.where("n_shingles = 0").select(F.col("ref").alias("_ref")).distinct()), "stay", 4)
    rest = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(1).alias("_one")), {"ignoreNullFields": "false"})
    packed = docs.select(F.struct(*docs.columns).alias("row"), row_key.alias("_ref"), F.struct(rest, F.col("text").isNull()).alias("_rest"))
    packed = packed.join(stay, "_ref", "left_semi").groupBy("_ref").agg(F.min_by("row", "_rest").alias("row"))
    return packed.select("row.*")
