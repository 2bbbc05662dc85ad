"""How far the word use of each source departs from the other sources of its language, and by which terms.

Tasks lower, split, dictionary-encode and group their texts with Arrow's own functions and hand on partial counts, packed as one
columnar block for each shard of terms.  The blocks of a shard are merged once, into one of the terms that enough documents of
the language hold.  Totals of the groups (language, source) come from the blocks, go to every shard as rows, and the shards compute their
part of each divergence, so no task needs the whole vocabulary.  A shard has as many cells as terms times sources; it works in
blocks of CELLS of them.

All arithmetic is on integers: a probability is a count of billionths, a divergence a sum of floors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from siftmoor.llm import words as w
from siftmoor.llm.common import buckets_for, stage, text_size

LEAST_DOCS, MOST_TERMS = 3, 200
SCALE = 10**9
CELLS = 1 << 20
HELD_ROWS = 1 << 18
LEAST_SHARDS, SALTS = 64, 16
_GAPS = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_TOTALS = "array<struct<lang:string,source:string,n:long,terms:long>>"


def _summed(parts: list[pa.Table]) -> pa.Table:
    """Partial counts with each (lang, source, term) once."""
    found = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def slice_counts(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each term per language and source, and a row without a term for each group."""
    lang, source = w.compact(batch["lang"]).dictionary_encode(), w.compact(batch["source"]).dictionary_encode()
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
    lists = pc.split_pattern_regex(pc.ascii_lower(w.compact(batch["text"])), _GAPS)
    terms, doc = lists.flatten(), pc.list_parent_indices(lists)
    there = pc.not_equal(terms, "")
    terms, doc = terms.filter(there).dictionary_encode(), doc.filter(there)
    each = pa.table({"doc": doc, "term": terms.indices}).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    each = each.append_column("group", pa.array(group[each["doc"].to_numpy()]))
    each = each.group_by(["group", "term"], use_threads=False).aggregate([("count_all", "sum"), ("count_all", "count")])
    groups = np.unique(group)
    at = np.concatenate([each["group"].to_numpy(), groups])
    none = pa.nulls(len(groups), pa.large_string())
    zero = np.zeros(len(groups), np.int64)
    return pa.table({
        "lang": lang.dictionary.take(pa.array(at // len(source.dictionary))), "source": source.dictionary.take(pa.array(at % len(source.dictionary))),
        "term": pa.concat_arrays([terms.dictionary.take(each["term"].combine_chunks()), none]),
        "n": np.concatenate([each["count_all_sum"].to_numpy(), zero]), "docs": np.concatenate([each["count_all_count"].to_numpy(), zero])})


def _packed(table: pa.Table) -> bytes:
    """A columnar block; languages and sources as codes."""
    table = pa.table({c: table[c].combine_chunks().dictionary_encode() if c in ("lang", "source") else table[c] for c in table.column_names})
    block = pa.BufferOutputStream()
    with pa.ipc.new_stream(block, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return block.getvalue().to_pybytes()


def _unpacked(block: pa.Scalar) -> pa.Table:
    table = pa.ipc.open_stream(block.as_buffer()).read_all()
    return pa.table({c: table[c].cast(pa.large_string()) if c in ("lang", "source") else table[c] for c in table.column_names})


def _by_shard(table: pa.Table, count: int) -> pa.RecordBatch:
    """The counts as one block for each shard that has any; a term's shard follows from its bytes, groups are in the first."""
    terms = table["term"].combine_chunks().cast(pa.large_binary()).dictionary_encode()
    shards = np.array([*(zlib.crc32(x) % count for x in terms.dictionary.to_pylist()), 0])[pc.fill_null(terms.indices, len(terms.dictionary)).to_numpy()]
    order, upto = w.by_bucket(shards, count)
    table, full = table.take(pa.array(order)), np.flatnonzero(np.diff(upto))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_packed(table.slice(upto[i], upto[i + 1] - upto[i])) for i in full.tolist()], pa.binary())], ["shard", "block"])


def _partial(count: int):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a task; more than HELD_ROWS distinct ones are handed on in parts."""
        held, rows = [], 0
        for batch in w.slices(batches, "text"):
            held.append(slice_counts(batch))
            rows += len(held[-1])
            if rows > HELD_ROWS:
                held = [_summed(held)]
                rows = len(held[0])
                if 2 * rows > HELD_ROWS:
                    yield _by_shard(held[0], count)
                    held, rows = [], 0
        if held:
            yield _by_shard(_summed(held), count)

    return partial


def _merge(least_docs: int):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        counts = _summed([_unpacked(x) for x in table["block"]])
        groups = counts.group_by(["lang", "source"], use_threads=False).aggregate([])
        counts = counts.filter(pc.is_valid(counts["term"])).sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])
        kept = {}
        if len(counts):
            lang, term = (counts[c].combine_chunks().dictionary_encode() for c in ("lang", "term"))
            code = lang.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()
            opens = np.flatnonzero(np.diff(code, prepend=-1))
            often = np.add.reduceat(counts["docs"].to_numpy(), opens) >= least_docs
            kept = dict(zip(lang.dictionary.to_pylist(), np.bincount(lang.indices.to_numpy()[opens[often]], minlength=len(lang.dictionary)).tolist()))
            counts = counts.filter(pa.array(np.repeat(often, np.diff(opens, append=len(code)))))
        counts = counts.select(["lang", "source", "term", "n"])
        sums = {(r["lang"], r["source"]): r["n_sum"] for r in counts.group_by(["lang", "source"], use_threads=False).aggregate([("n", "sum")]).to_pylist()}
        totals = [{"lang": r["lang"], "source": r["source"], "n": sums.get((r["lang"], r["source"]), 0), "terms": kept.get(r["lang"], 0)} for r in groups.to_pylist()]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("terms", pa.int64())]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([_packed(counts)], pa.binary()), "totals": pa.array([totals], kind)})

    return merge


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / total), by long division in two steps so that no product leaves 64 bits."""
    step = 10**5
    whole, rest = np.divmod((counts + 1) * step, total)
    return 1 + whole * (SCALE // step) + rest * (SCALE // step) // total


def _divergences(most_terms: int):
    def compute(key: tuple, blocks: pa.Table, totals: pa.Table) -> pa.Table:
        rows = {"lang": [], "source": [], "part": [], "item": [], "value": []}

        def tell(lang: str, source: str, part: str, items: list, values: list) -> None:
            for name, column in zip(rows, ([lang] * len(items), [source] * len(items), [part] * len(items), items, values)):
                rows[name] += column

        counts = _unpacked(blocks["block"][0]) if len(blocks) else None
        for lang in pc.unique(totals["lang"]).to_pylist():
            groups = totals.filter(pc.equal(totals["lang"], lang)).sort_by("source")
            sources, n = groups["source"].to_pylist(), groups["n"].to_numpy()
            terms = groups["terms"][0].as_py()
            own = counts.filter(pc.equal(counts["lang"], pa.scalar(lang, pa.large_string()))) if counts is not None else []
            if not len(own) and key[0].as_py():
                continue
            pairs = np.zeros((len(sources), len(sources)), np.int64)
            if len(own):
                coded = own["term"].combine_chunks().dictionary_encode()
                term, n_terms = coded.indices.to_numpy(), len(coded.dictionary)
                place = pc.index_in(own["source"], value_set=groups["source"].combine_chunks().cast(pa.large_string())).to_numpy()
                times, step = own["n"].to_numpy(), max(1, CELLS // len(sources))
                for low in range(0, n_terms, step):
                    inside = slice(*np.searchsorted(term, [low, low + step]))
                    cells = np.zeros((min(step, n_terms - low), len(sources)), np.int64)
                    cells[term[inside] - low, place[inside]] = times[inside]
                    p, q = shares(cells, n + terms), shares(cells.sum(axis=1), int(n.sum()) + terms)
                    for i, source in enumerate(sources):
                        apart = p[:, i : i + 1] - p
                        pairs[i] += (apart * apart // p).sum(axis=0)
                        more = np.flatnonzero((cells[:, i] > 0) & (p[:, i] > q))
                        value = (p[more, i] - q[more]) ** 2 // q[more]
                        best = np.argsort(-value, kind="stable")[:most_terms]
                        tell(lang, source, "term", coded.dictionary.take(pa.array(more[best] + low)).to_pylist(), value[best].tolist())
            for i, source in enumerate(sources):
                tell(lang, source, "pair", sources[:i] + sources[i + 1 :], np.delete(pairs[i], i).tolist())
        return pa.table({name: pa.array(column, pa.int64() if name == "value" else pa.string()) for name, column in rows.items()})

    return compute


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: for each group its divergence from every other source of the language (part
    `pair`) and the `most_terms` terms that set it apart from the language (part `term`).

    Null texts, languages and sources count as empty ones; a group without terms has its pairs, and a language in which no term is
    kept has pairs of value 0.  Every row is a document of its own, also if ids repeat.  Ties go to the smaller item in bytes.
    An empty table gives no rows; other columns play no part.
    """
    count = max(LEAST_SHARDS, buckets_for(2 * text_size(docs, text_col)))
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    partial = rows.mapInArrow(_partial(count), "shard int, block binary")
    blocks = stage(partial.groupBy("shard").applyInArrow(_merge(least_docs), f"shard int, block binary, totals {_TOTALS}"), "term-blocks")
    groups = blocks.select(F.explode("totals").alias("t"), "shard").select("t.*", "shard")
    kept = groups.select("lang", "shard", "terms").distinct().groupBy("lang").agg(F.sum("terms").alias("terms"))
    totals = groups.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(kept, "lang")
    totals = totals.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select("shard", "lang", "source", "n", "terms")
    told = blocks.select("shard", "block").groupBy("shard").cogroup(totals.groupBy("shard")).applyInArrow(
        _divergences(most_terms), "lang string, source string, part string, item string, value long")
    told = stage(told, "divergences")
    order = [F.desc("value"), F.asc("item")]
    pairs = told.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    terms = told.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    for keys in (["lang", "source", "salt"], ["lang", "source"]):
        terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most_terms)
    return pairs.unionByName(terms.drop("salt"))
