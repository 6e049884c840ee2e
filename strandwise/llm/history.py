"""Deduplicating new batches against all history by fingerprints in rotated block tables.

A `FingerprintStore` keeps what was accepted: canonical records with their fingerprints, block tables partitioned by
ranges of keys, the word counts of the history and the wordings learned so far. A batch is signed, looked up by exact
block matches in the partitions its keys fall in, tested by bit difference, verified on the whole texts, and appended.
Nothing of the history is parsed or signed again, and its original tables are not read.

Claims are verified without word lists. What two statements with equal figures do not share is a residue of words. A
residue is harmless if it consists of typing errors (of a word the history does not use, or hardly beside the other
one), of wordings learned from the residues of all pairs (a word the accepted history never uses that stands again and
again for one it does use, or that belongs to a phrase added before or after), or of function words that replace each
other. Everything else, such as another group, place or direction, tells two findings apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.fingerprints import BLOCK_BITS, BLOCKS, MAP_BITS, PER_WORD, WORDS, difference, first_bits, in_map, kept_signer, map_of, packed
from strandwise.llm.records import GENERIC_WORDS, Record, compare, comparable, finding, other_people, record, residue, same_publication, slip
from strandwise.session import cut, release, shared_folder

#: Largest bit difference of 320 that goes on to the text.
MAX_DIFFERENCE = 64
#: Bits of a key that choose its partition of the block tables.
PART_BITS = 4
FIELDS = ("title", "authors", "year", "doi")
#: Of each view a word of facts and the words of its fingerprint, one view after the other; words and figures are parted by blanks.
_EXTRA = "figures string, words string, views array<bigint>, exact array<bigint>, bare bigint"
_STRIDE = 1 + WORDS
#: Tables of a store; an append may leave no file.
_TABLES = {
    "records": f"id string, title string, authors array<string>, year int, doi string, at timestamp, h1 bigint, h2 bigint, rid bigint, {_EXTRA}, n int, bin int",
    "blocks": "key bigint, rid bigint, view smallint, facts bigint, n int, part bigint",
    "words": "word string, n_texts bigint, n int",
}
#: Views of a record that are told apart when two records meet.
_VIEWS = 8
_SHORT = (1 << 30) - 1
#: Roles of exact keys: to be found, to ask, or both.
_FOUND, _ASKS, _BOTH = 1, 2, 3
#: Largest difference of those 30 bits.
MAX_SHORT = 9
#: A function word stands in so large a share of the history's texts.
FUNCTION_WORD = 0.1
#: A wording is learned from so many different findings, if chance would let so many of its uses fall into the history.
LEAST_FINDINGS, LEAST_EXPECTED = 2, 5.0


def _never() -> Column:
    """A time before all others, for what was accepted from the beginning."""
    return F.timestamp_micros(F.lit(-(2**60)))


def _exact(key: str) -> int:
    """Keys of exact matches are odd, those of blocks even."""
    return (xxhash.xxh3_64_intdigest(key) | 1) - 2**63


@lru_cache(100_000)
def _surname_bits(last: str) -> int:
    return 1 << (xxhash.xxh3_64_intdigest("^" + last[:3]) % 28) | 1 << (xxhash.xxh3_64_intdigest(last[-3:] + "$") % 28)


def _facts(r: Record) -> int:
    """28 bits of authors, two for each by the first and the last letters of the surname, so one typing error spares one; 6 of the year."""
    mark = 0
    for last, _ in r.authors:
        mark |= _surname_bits(last)
    return mark << 36 | (1 + r.year % 63 if r.year else 0) << 30


def source_views(r: Record) -> list[list[tuple[str, float]]]:
    """Feature lists of a publication: each wording of its title, and each title segment with the authors."""
    people = [(f"{last} {first}", 6.0) for last, first in sorted(r.authors)]
    out = []
    for w in r.wordings:
        words = [(t, 1.0) for t in w.tokens]
        if len(words) >= GENERIC_WORDS or not people or any(len(t) > 8 for t in w.tokens):
            out.append(words + [(n, 6.0) for n in w.numbers])
        if people:
            longest = max(w.segments, key=len)
            out.append([(t, 1.0) for t in longest if not t[0].isdigit()] + people)
    return out


def _doi_keys(r: Record) -> tuple[list[int], int | None]:
    """A DOI is looked up together with what must agree besides, so that a DOI of many works makes no large bucket; and the bare DOI.

    The bare key has 1 in its second bit for records with neither title nor author.
    """
    if not r.doi:
        return [], None
    words = sorted({t for w in r.wordings for t in w.tokens}, key=lambda t: (-len(t), t))[:3]
    keys = [_exact(f"{r.doi} {x}") for x in {*words, *(last[:4] for last, _ in r.authors)}]
    bare = _exact(r.doi) & ~2
    return keys, bare if keys else bare | 2


def _lists(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int64()))


def _flat(facts: np.ndarray, prints: np.ndarray, sizes: list[int]) -> pa.ListArray:
    """The views of each record in one list."""
    both = np.concatenate((facts[:, None], prints), axis=1)
    return _lists(both.ravel(), [_STRIDE * n for n in sizes])


def _with(batch: pa.RecordBatch, *added: pa.Array) -> pa.RecordBatch:
    """The batch with the columns of `_EXTRA` and whatever comes after them; its own are passed on as they are."""
    names = [x.split()[0] for x in _EXTRA.split(", ")] + ["form"]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names[: len(added)]])


def _form(r: Record) -> str:
    """Digest of a record as it is compared: records of one form differ in nothing the comparison sees."""
    return xxhash.xxh3_128_hexdigest(repr((r.wordings, sorted(r.authors), r.partial_authors, r.year, r.doi)).encode("utf-8", "surrogatepass"))


def _sign_sources(batches: Iterator[pa.RecordBatch], forms: bool = False) -> Iterator[pa.RecordBatch]:
    signer = kept_signer()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        views, facts, sizes, exact, n_exact, bare, form = [], [], [], [], [], [], []
        for fields in zip(*[batch.column(c).to_pylist() for c in FIELDS], strict=True):
            r = record(*fields)
            own = source_views(r)
            views += own
            sizes.append(len(own))
            facts += [_facts(r)] * len(own)
            keys, doi = _doi_keys(r)
            exact += keys
            n_exact.append(len(keys))
            bare.append(doi)
            if forms:
                form.append(_form(r))
        prints = packed(signer.sign(views))
        # 30 bits of the fingerprint go with the facts, for a first test in the bucket
        marked = np.array(facts, dtype=np.uint64).view(np.int64) | (prints[:, 0] & _SHORT)
        added = [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), _flat(marked, prints, sizes), _lists(np.array(exact, dtype=np.int64), n_exact), pa.array(bare, pa.int64())]
        yield _with(batch, *added, *([pa.array(form, pa.string())] if forms else []))


def _sign_claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer = kept_signer()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        found = [finding(t) if t is not None else None for t in batch.column("title").to_pylist()]
        # figures weigh as much as many words: renderings keep them, other findings seldom share them
        views = [[(w, 1.0) for w in f.words if len(w) > 3] + [(x, 8.0) for x in f.figures] if f and f.words else [] for f in found]
        full = [v for v in views if v]
        figures = [" ".join(f.figures) if f else None for f in found]
        facts = np.array([xxhash.xxh3_64_intdigest(x) for x, v in zip(figures, views, strict=True) if v], dtype=np.uint64).view(np.int64)
        words = [" ".join(f.words) if f else None for f in found]
        none = _lists(np.array([], dtype=np.int64), [0] * n)
        yield _with(batch, pa.array(figures, pa.string()), pa.array(words, pa.string()), _flat(facts, packed(signer.sign(full)), [int(bool(v)) for v in views]), none, pa.nulls(n, pa.int64()))


def _sign(df: DataFrame, kind: str, forms: bool = False) -> DataFrame:
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    if forms:
        return df.mapInArrow(lambda batches: _sign_sources(batches, True), f"{schema}, {_EXTRA}, form string")
    return df.mapInArrow(_sign_sources if kind == "source" else _sign_claims, f"{schema}, {_EXTRA}")


def one_of_each(records: DataFrame) -> DataFrame:
    """Of records with the same fields the earliest, of equals the smallest id; `h1`, `h2` are 128 bits that stand for the fields."""
    hashed = records.select("id", *FIELDS, "at", F.xxhash64(*FIELDS).alias("h1"), F.xxhash64(F.lit(1), *reversed(FIELDS)).alias("h2"))
    first = F.min(F.struct(F.coalesce("at", _never()).alias("at"), "id")).alias("head")
    heads = hashed.groupBy("h1", "h2").agg(first, *[F.first(c).alias(c) for c in FIELDS])
    return heads.select("head.id", *FIELDS, F.when(F.col("head.at") > _never(), F.col("head.at")).alias("at"), "h1", "h2")


def signed_records(records: DataFrame, kind: str, n: int = 0, forms: bool = False) -> DataFrame:
    """Records with a number `rid` (unique over all `n`), their canonical words and fingerprints; to be written or cut before use.

    A number is made of `n`, the task (also in `bin`) and the row in it. With `forms` a digest of the canonical record is added.
    """
    row = F.monotonically_increasing_id()
    numbered = records.withColumn("bin", F.shiftright(row, 33).cast("int")).withColumn("rid", F.lit(n << 53) + row)
    return _sign(numbered, kind, forms)


def block_table(signed: DataFrame, kind: str) -> DataFrame:
    """`(key, rid, view, facts)`: the rotated tables of signed records; findings are keyed by their figures instead of facts."""
    # one step for a word and one for a block of it: sixteen expressions beside each other make a method too long to be compiled
    words = signed.select("rid", "views", F.posexplode("views").alias("p", "word")).where(f"p % {_STRIDE} <> 0")
    blocks = words.select("rid", "word", F.expr(f"views[p - p % {_STRIDE}]").alias("facts"), F.expr(f"p div {_STRIDE}").cast("short").alias("view"), F.expr(f"p % {_STRIDE} - 1").alias("at"), F.explode(F.lit(list(range(PER_WORD)))).alias("b"))
    blocks = blocks.select("rid", "view", "facts", (F.col("at") * PER_WORD + F.col("b")).alias("k"), F.expr(f"shiftright(word, b * {BLOCK_BITS})").bitwiseAND((1 << BLOCK_BITS) - 1).alias("block")).where(f"k < {BLOCKS}")
    if kind != "source":
        return blocks.select(F.xxhash64("facts", "k", "block").bitwiseAND(~1).alias("key"), "rid", "view", F.lit(0).cast("long").alias("facts"))
    table = blocks.select(F.shiftleft(F.shiftleft(F.col("k").cast("long"), BLOCK_BITS).bitwiseOR(F.col("block")), 64 - 4 - BLOCK_BITS).alias("key"), "rid", "view", "facts")
    exact = signed.select("rid", F.explode("exact").alias("key"), F.lit(_BOTH).alias("role"))
    # under the bare DOI all are found but only those that have nothing else ask, and all ask for those; so the many works
    # of one DOI never meet under it
    poor, doi = F.col("bare").bitwiseAND(2) == 2, F.col("bare").bitwiseAND(~2)
    pairs = F.array(
        F.struct(doi.alias("key"), F.when(poor, _BOTH).otherwise(_FOUND).alias("role")), F.struct(doi.bitwiseOR(2).alias("key"), F.when(poor, _FOUND).otherwise(_ASKS).alias("role"))
    )
    bare = signed.where("bare is not null").select("rid", F.explode(pairs).alias("x")).select("rid", "x.key", "x.role")
    exact = exact.unionByName(bare).select("key", "rid", F.col("role").cast("short").alias("view"), F.lit(0).cast("long").alias("facts"))
    return table.unionByName(exact)


def _parts(words: DataFrame) -> list[int]:
    """The partitions of the block tables in which keys of a map fall: 2**PART_BITS at most."""
    return [int(r.p) for r in words.select(F.shiftright("w", MAP_BITS - 6 - PART_BITS).alias("p")).distinct().collect()]


def candidates(new: DataFrame, stored: DataFrame, kind: str) -> DataFrame:
    """`(rid, old_rid, exact, met)`: pairs in one bucket that can be the same by their authors' bits and years."""
    old = stored.select("key", F.col("rid").alias("old_rid"), F.col("view").alias("old_view"), F.col("facts").alias("old_facts"))
    exact = F.col("key").bitwiseAND(1) == 1
    if kind == "source":
        # exact keys carry their role in place of a view
        new, old = new.where(~exact | (F.col("view").bitwiseAND(_ASKS) == _ASKS)), old.where(~exact | (F.col("old_view").bitwiseAND(_FOUND) == _FOUND))
    pairs = new.join(old, "key").where("rid <> old_rid")
    if kind == "source":
        mark, old_mark = F.shiftrightunsigned("facts", 36), F.shiftrightunsigned("old_facts", 36)
        year, old_year = F.shiftright("facts", 30).bitwiseAND(63), F.shiftright("old_facts", 30).bitwiseAND(63)
        # half of the shorter list of authors must agree, each in one of two bits at least
        people = (mark == 0) | (old_mark == 0) | (F.bit_count(mark.bitwiseAND(old_mark)) * 4 >= F.least(F.bit_count(mark), F.bit_count(old_mark)))
        years = (year == 0) | (old_year == 0) | F.abs(year - old_year).isin(0, 1, 62)
        near = F.bit_count(F.col("facts").bitwiseXOR(F.col("old_facts")).bitwiseAND(_SHORT)) <= MAX_SHORT
        pairs = pairs.where(exact | (near & people & years))
    # which views met, as a bit for each two of the first ones: numbers are aggregated by hash, sets would be sorted
    last = F.lit(_VIEWS - 1)
    bit = F.least(F.col("view").cast("int"), last) * _VIEWS + F.least(F.col("old_view").cast("int"), last)
    met = F.when(exact, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return pairs.groupBy("rid", "old_rid").agg(F.max(exact).alias("exact"), F.bit_or(met).alias("met"))


def close_pairs(hits: DataFrame, new: DataFrame, old: DataFrame, columns: tuple[str, ...], most: int = MAX_DIFFERENCE) -> DataFrame:
    """Candidates with the `columns` of both sides (the stored one's with a 2), of which some fingerprints differ in few bits."""
    a = new.select("rid", "views", *columns)
    b = old.select(F.col("rid").alias("old_rid"), F.col("views").alias("views2"), *[F.col(c).alias(f"{c}2") for c in columns])
    def bits(views: str, view: Column) -> Column:
        return F.slice(views, view * _STRIDE + 2, F.lit(WORDS))

    # the last place stands for all further views, which go on untested
    every = [x for x in range(_VIEWS**2) if _VIEWS - 1 not in divmod(x, _VIEWS)]
    met = F.filter(F.lit(every), lambda x: F.call_function("shiftright", F.col("met"), x).bitwiseAND(1) == 1)
    near = F.exists(met, lambda x: difference(bits("views", F.shiftright(x, 3)), bits("views2", x.bitwiseAND(_VIEWS - 1))) <= most)
    further = F.col("met").bitwiseAND(sum(1 << x for x in range(_VIEWS**2) if x not in every) - (1 << 64)) != 0
    return hits.join(a, "rid").join(b, "old_rid").where(F.col("exact") | near | further).drop("views", "views2", "met", "exact")


@dataclass
class FingerprintStore:
    """Accepted records on shared storage: `records` by bin, `blocks` by key range, `words` and `wordings` (of claims).

    Tables are Parquet folders under `path` that are only appended to. Appending distinct records again is the caller's
    matter: `accept` appends only what repeats nothing. Copies within one append are kept once, under the earliest (of
    equals the smallest) id.
    """

    spark: SparkSession
    path: str
    kind: str
    appends: int = 0

    def _read(self, name: str) -> DataFrame | None:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}") if self.appends else None

    def signed(self, records: DataFrame) -> DataFrame:
        """`records(id, title, authors, year, doi, at, h1, h2)` with `rid`, canonical words and fingerprints; unique rids beyond all stored ones."""
        return signed_records(records, self.kind, self.appends)

    def append(self, records: DataFrame) -> None:
        """Sign and store `records(id, title, authors, year, doi, at)`; null ids and empty records are kept and match nothing."""
        self.append_signed(self.signed(one_of_each(records)))

    def append_signed(self, signed: DataFrame) -> None:
        n = self.appends
        signed.write.partitionBy("bin").parquet(f"{self.path}/records/n={n}")
        mine = self.spark.read.schema(_TABLES["records"]).parquet(f"{self.path}/records/n={n}")
        blocks = block_table(mine, self.kind).withColumn("part", first_bits(F.col("key"), PART_BITS)).write.partitionBy("part")
        # hardly a value occurs twice, so dictionaries cost time and room; numbers of records go by their differences
        blocks.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0").parquet(f"{self.path}/blocks/n={n}")
        if self.kind == "claim":
            mine.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n_texts")).write.parquet(f"{self.path}/words/n={n}")
        self.appends += 1

    def size(self) -> int:
        return self._read("records").count() if self.appends else 0

    def found(self, table: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Candidates of a batch (its block table and signed records) among the stored and its own ones, and the records of both."""
        buckets, records = table, new
        if self.appends:
            words = cut(map_of(table, F.col("key")))
            stored = self._read("blocks").where(F.col("part").isin(_parts(words))).select(*table.columns)
            buckets = table.unionByName(in_map(stored, F.col("key"), words))
        hits = cut(candidates(table, buckets, self.kind))
        if self.appends:
            # what was shuffled for the buckets goes before the records are
            del words, stored, buckets
            release(self.spark)
            # which appends and tasks wrote the records that were hit: one row for each of their files at most
            files = hits.where(F.shiftright("old_rid", 53) < self.appends).select((F.shiftright("old_rid", 33) % (1 << 20)).cast("int").alias("bin")).distinct()
            records = self._read("records").where(F.col("bin").isin([r.bin for r in files.collect()])).select(*new.columns).unionByName(new)
        return hits, records

    def drop(self) -> None:
        sc = self.spark.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def new_store(spark: SparkSession, kind: str) -> FingerprintStore:
    return FingerprintStore(spark, f"{shared_folder(spark)}/fingerprints-{kind}-{uuid.uuid4().hex}", kind)


def _verify_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed: dict[int, Record] = {}

    def once(rid: int, row: int, columns: list[pa.Array]) -> Record:
        r = parsed.get(rid)
        if r is None:
            if len(parsed) > 50_000:
                parsed.clear()
            r = parsed[rid] = record(*[c[row].as_py() for c in columns])
        return r

    for batch in batches:
        score = []
        left, right = [batch.column(c) for c in FIELDS], [batch.column(f"{c}2") for c in FIELDS]
        for n, (i, j) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("old_rid").to_pylist(), strict=True)):
            one, two = once(i, n, left), once(j, n, right)
            if other_people(one, two):
                score.append(0.0)
                continue
            alike = compare(one, two)
            score.append(2 * alike[0] + alike[1] + alike[2] + 3 * alike[3] if same_publication(one, two, alike) else 0.0)
        link = [batch.column(c) for c in ("rid", "old_rid", "at2", "id2")]
        kept = pa.RecordBatch.from_arrays([*link, pa.array(score, pa.float64())], names=["rid", "old_rid", "at2", "id2", "score"]).filter(pa.array([x > 0 for x in score], pa.bool_()))
        if kept.num_rows:
            yield kept


_LINK = "rid long, old_rid long, at2 timestamp, id2 string, score double"
_RESIDUE = f"{_LINK}, finding long, lead array<string>, tail array<string>, x array<string>, y array<string>"


def _residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, j, at, name, f, w, f2, w2 in zip(*[pdf[c] for c in ("rid", "old_rid", "at2", "id2", "figures", "words", "figures2", "words2")], strict=True):
            if f != f2:
                continue
            a, b = tuple(w.split()), tuple(w2.split())
            r = residue(a, b)
            if comparable(a, b, r):
                shared = 1 - (len(r.left) + len(r.right)) / (len(a) + len(b))
                # findings without figures teach nothing: too little agrees besides
                mark = xxhash.xxh3_64_intdigest(f) - 2**63 if f else None
                rows.append((i, j, at, name, shared, mark, list(r.lead), list(r.tail), list(r.left), list(r.right)))
        if rows:
            yield pd.DataFrame(rows, columns=["rid", "old_rid", "at2", "id2", "score", "finding", "lead", "tail", "x", "y"])


def _split_slips(x: list[str], y: list[str], uses: dict[str, int]) -> tuple[list[str], list[str]]:
    """What is left of a residue without typing errors; a word that the history uses by itself is none."""
    left, right = [], list(y)
    if "".join(x) == "".join(y):
        return [], []
    for t in x:
        for u in right:
            rare, usual = sorted((uses.get(t, 0), uses.get(u, 0)))
            if 100 * rare <= usual and slip(t, u):
                right.remove(u)
                break
        else:
            left.append(t)
    if "".join(left) == "".join(right):
        return [], []
    return left, right


def _units(x: list[str], y: list[str], uses: dict[str, int]) -> list[tuple[str, str]]:
    """(word, key) of a residue as one replacement; the word is the side the history does not use, '' for two function words."""
    out = []
    for a, b in ((x, y), (y, x)):
        new = [t for t in a if not uses.get(t, 0)]
        if new and b and all(uses.get(t, 0) for t in b):
            out.append((new[0], f"{' '.join(sorted(a))}|{' '.join(sorted(b))}"))
    if not out and len(x) == len(y) == 1 and all(uses.get(t, 0) for t in (x[0], y[0])):
        out.append(("", "|".join(sorted((x[0], y[0])))))
    return out


def _wordings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of a residue: `pure` ones are all of it and teach, the others are parts that may have been learned elsewhere."""
    for pdf in batches:
        rows = []
        for i, j, mark, lead, tail, x, y, uses in zip(*[pdf[c] for c in ("rid", "old_rid", "finding", "lead", "tail", "x", "y", "uses")], strict=True):
            uses = dict(uses)
            lead, tail, x, y = list(lead), list(tail), list(x), list(y)
            left, right = _split_slips(x, y, uses)
            added = [(next((t for t in a if not uses.get(t, 0)), None), f"{'^' if a is lead else '$'}{' '.join(a)}") for a in (lead, tail) if a]
            added = [(w, k) for w, k in added if w is not None]
            pure = mark is not None and mark == mark
            seen = set()
            for w, k in added:
                rows.append((i, j, w, k, pure and not left and not right and not (lead and tail), mark))
            whole = _units(x, y, uses) if x and y else []
            rest = _units(left, right, uses) if left and right else []
            for units, size in ((whole, len(x) + len(y)), (rest, len(left) + len(right))):
                for w, k in units:
                    if k not in seen:
                        seen.add(k)
                        # one word for one or two others: more at once are several wordings, which are learned singly
                        rows.append((i, j, w, k, pure and size <= 3 and not lead and not tail, mark))
            for n, t in enumerate(left):
                for m, u in enumerate(right):
                    pairs = [([t], [u])] + ([([t, left[n + 1]], [u])] if n + 1 < len(left) else []) + ([([t], [u, right[m + 1]])] if m + 1 < len(right) else [])
                    for a, b in pairs:
                        for w, k in _units(a, b, uses):
                            if k not in seen:
                                seen.add(k)
                                rows.append((i, j, w, k, False, mark))
        if rows:
            yield pd.DataFrame(rows, columns=["rid", "old_rid", "word", "wording", "pure", "finding"])


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose residue is made of typing errors and learned wordings."""
    for pdf in batches:
        keep = []
        for lead, tail, x, y, uses, known in zip(*[pdf[c] for c in ("lead", "tail", "x", "y", "uses", "known")], strict=True):
            uses, known = dict(uses), set(known) if known is not None else set()
            ok = (not len(lead) or f"^{' '.join(lead)}" in known) and (not len(tail) or f"${' '.join(tail)}" in known)
            keep.append(ok and _explained(list(x), list(y), uses, known))
        if any(keep):
            yield pdf[np.array(keep)][["rid", "old_rid", "at2", "id2", "score"]]


def _explained(x: list[str], y: list[str], uses: dict[str, int], known: set[str]) -> bool:
    def learned(a: list[str], b: list[str]) -> bool:
        return any(k in known for _, k in _units(a, b, uses))

    if not x and not y:
        return True
    if x and y and learned(x, y):
        return True
    x, y = _split_slips(x, y, uses)
    if not x and not y:
        return True
    for n, t in enumerate(x):
        for m, u in enumerate(y):
            for a, b in (([t], [u]), (x[n : n + 2], [u]), ([t], y[m : m + 2])):
                if learned(a, b):
                    return _explained([w for i, w in enumerate(x) if not n <= i < n + len(a)], [w for i, w in enumerate(y) if not m <= i < m + len(b)], uses, known)
    return False


def _same_claims(store: FingerprintStore, pairs: DataFrame, n_batch: int) -> DataFrame:
    """`(rid, old_rid, score)` of the pairs that state one finding; the wordings found are kept with the store."""
    spark = store.spark
    rests = cut(pairs.mapInPandas(_residues, _RESIDUE))
    every = F.concat("lead", "tail", "x", "y")
    link = ["rid", "old_rid", "at2", "id2", "score"]
    equal = rests.where(F.size(every) == 0).select(*link)
    rests = rests.where(F.size(every) > 0)
    n_old = store.size()
    need = rests.select("rid", "old_rid", F.explode(F.array_distinct(every)).alias("word"))
    words = store._read("words")
    if words is None:
        words = spark.createDataFrame([], "word string, n_texts long")
    counted = need.join(words.groupBy("word").agg(F.sum("n_texts").alias("n_texts")), "word", "left").groupBy("rid", "old_rid").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.coalesce("n_texts", F.lit(0)).alias("n")))).alias("uses")
    )
    rests = cut(rests.join(counted, ["rid", "old_rid"]))
    parts = cut(rests.mapInPandas(_wordings, "rid long, old_rid long, word string, wording string, pure boolean, finding long"))
    lessons = parts.where("pure").select("word", "wording", "finding").distinct()
    earlier = _wordings_kept(store)
    lessons = lessons if earlier is None else lessons.unionByName(earlier).distinct()
    support = lessons.groupBy("word", "wording").agg(F.count("*").alias("n"))
    of_word = support.groupBy("word").agg(F.sum("n").alias("all_n"))
    # a new word: the chance that the history, so much larger than its uses, should lack it; a pair of old ones: both function words
    fresh = (F.col("word") != "") & (F.col("n") * F.lit(n_old / max(n_batch, 1)) >= LEAST_EXPECTED) & (F.col("n") >= 0.8 * F.col("all_n"))
    least = FUNCTION_WORD * n_old
    common = words.groupBy("word").agg(F.sum("n_texts").alias("n_texts")).where(F.col("n_texts") >= max(least, 1.0)).select("word")
    pair = F.split("wording", r"\|")
    plain = support.where("word = ''").select("wording", "n", pair[0].alias("a"), pair[1].alias("b"))
    plain = plain.join(common.withColumnRenamed("word", "a"), "a", "left_semi").join(common.withColumnRenamed("word", "b"), "b", "left_semi").where(F.col("n") >= LEAST_FINDINGS)
    learned = support.join(of_word, "word").where(fresh & (F.col("n") >= LEAST_FINDINGS)).select("wording").unionByName(plain.select("wording")).distinct()
    lessons.write.parquet(f"{store.path}/wordings/{uuid.uuid4().hex}")
    known = parts.join(learned, "wording").groupBy("rid", "old_rid").agg(F.collect_set("wording").alias("known"))
    settled = rests.join(known, ["rid", "old_rid"], "left").mapInPandas(_settle, _LINK)
    return equal.unionByName(settled)


def _wordings_kept(store: FingerprintStore) -> DataFrame | None:
    sc = store.spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(f"{store.path}/wordings")
    there = folder.getFileSystem(sc._jsc.hadoopConfiguration()).exists(folder)
    return store.spark.read.option("recursiveFileLookup", "true").parquet(f"{store.path}/wordings") if there else None


def accept_batch(store: FingerprintStore, batch: DataFrame, append: bool = True) -> DataFrame:
    """`(id, accepted)`: records of `batch(id, title, authors, year, doi, at)` that repeat an accepted one, each with the accepted record.

    Claims have their statement as `title` and null elsewhere. `at` has no ties; records are accepted in that order, and a
    record that repeats nothing becomes accepted itself and is appended to the store (unless `append` is false). Records that
    repeat a repetition are given the accepted record it stands for. Null or empty titles are compared by DOI and authors only;
    records without both match nothing; an empty batch gives no rows; other columns are ignored.
    """
    kind = store.kind
    # Records rendered alike are compared once; the first of them stands for the others.
    new = batch.select("id", *FIELDS, F.col("at").cast("timestamp").alias("at"))
    heads = one_of_each(new)
    signed = cut(store.signed(heads))
    table = block_table(signed, kind)
    hits, records = store.found(table, signed)
    columns = ("at", "id", *(FIELDS if kind == "source" else ("figures", "words")))
    pairs = close_pairs(hits, signed, records, columns).where(F.col("at2").isNull() | (F.col("at2") < F.col("at")))
    if kind == "source":
        links = cut(pairs.mapInArrow(_verify_sources, _LINK))
    else:
        links = cut(_same_claims(store, pairs, signed.count()))
    del table, hits, records, pairs
    release(store.spark)
    # the closest; of equals history first, then the earliest batch record
    best = links.groupBy("rid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.coalesce("at2", _never()).alias("at"), "old_rid", "id2")).alias("b"))
    roots = cut(best.select("rid", F.col("b.old_rid").alias("up"), F.col("b.id2").alias("accepted")))
    while True:
        higher = roots.select(F.col("rid").alias("up"), F.col("up").alias("top"), F.col("accepted").alias("named"))
        # only records of this batch can repeat something themselves
        step = roots.where(F.shiftright("up", 53) == store.appends).join(higher, "up")
        moved = cut(step.select("rid", F.col("top").alias("up"), F.col("named").alias("accepted")))
        if moved.isEmpty():
            break
        roots = cut(roots.join(moved.select("rid"), "rid", "left_anti").unionByName(moved))
    mine = signed.select("rid", F.col("id").alias("head"), "h1", "h2").join(roots.select("rid", "accepted"), "rid", "left")
    # copies follow their head: to what it repeats, or to itself
    copies = new.select("id", F.xxhash64(*FIELDS).alias("h1"), F.xxhash64(F.lit(1), *reversed(FIELDS)).alias("h2"))
    out = copies.join(mine, ["h1", "h2"]).select("id", F.coalesce("accepted", F.when(F.col("id") != F.col("head"), F.col("head"))).alias("accepted"))
    out = cut(out.where("accepted is not null").distinct())
    if append:
        store.append_signed(signed.join(roots.select("rid"), "rid", "left_anti").select(*signed.columns))
    return out


def repeated_records(history: DataFrame, batches: DataFrame, kind: str) -> DataFrame:
    """`(id, accepted)` of all batches at once against a new store of `history(id, title, authors, year, doi)`; see `accept_batch`.

    The store is made for this call and removed; to keep one, use `new_store`, `append` and `accept_batch`. Repeated history
    rows count once; of copies in the history the smallest id stands for all.
    """
    store = new_store(history.sparkSession, kind)
    store.append(history.select("id", *FIELDS, F.lit(None).cast("timestamp").alias("at")))
    release(store.spark)
    out = accept_batch(store, batches, append=False)
    store.drop()
    release(store.spark)
    return out
