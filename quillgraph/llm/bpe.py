"""Byte-level BPE encoding and decoding by recursive queries in DuckDB, one database a worker.

A text is parted into words by the vocabulary's pattern. Words not met before become rows (word, tokens), one token a byte at first. In each step of the recursive query every token takes its
position and its neighbour, these join the merge table, and each word contracts its pair of least rank, from left to right wherever it stands; words without such a pair leave the recursion. A
pair that a contraction makes ranks higher than the one contracted, as in any vocabulary that was built by merging, so this is what contracting the leftmost pair one place a step comes to. Decoding joins
tokens with the vocabulary and aggregates their bytes in order of position. A document's ids and bytes are those of its words, in order. Words are met again and again, so a worker keeps what it found for a
bounded number of them.

A word of any length takes this way; steps are as many as it has distinct merges (a letter repeated 300,000 times takes a few, 20,000 random letters some 700).

A single blank begins the word after it, so a text can be parted at blanks that have other text before them; only texts with a blank between or after white space are parted as a whole.

Null texts count as empty: no ids, no bytes. Rows that repeat keep a row each; an empty table gives an empty result; of docs only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCAB = "byte_bpe_multi_50k.tiktoken"
KEPT = 400_000  # segments a worker keeps of those met lately, and as many of those met before
BATCH = 60_000  # words a query takes
SEGMENT = 64  # longer stretches without a blank aren't kept
CHAR = 0x10000  # a token is the character of its id and this, so that a word's tokens are one string

_AWKWARD = re.compile(r"\s (?:\s|\Z)")

# A pair's key is its rank, and which of the ways to part the bytes it makes.
RECURSION = f"""
with recursive g(w, s) using key (w) as (
  select w, s from fresh
  union
  select g.w, replace(g.s, m.pair, m.made)
  from g
  join (
    select n.w, min(m.key) as key
    from (select w, unnest(t[:-2]) || unnest(t[2:]) as pair from (select w, string_split(s, '') as t from g)) n
    join merges m on m.pair = n.pair
    group by n.w
  ) least on least.w = g.w
  join merges m on m.key = least.key
)
select w, list_transform(string_split(s, ''), lambda c: unicode(c) - {CHAR}) as t from g
"""
IDS = "select w, array_to_string(t, ',') as ids from merged order by w"
DECODE = "select w, string_agg(v.bytes, '' order by x.p) as bytes from (select w, unnest(t) as t, unnest(range(len(t))) as p from merged) x join vocab v on v.t = x.t group by w order by w"


def narrow(pattern: str):
    """The pattern for texts of characters under U+0250, by the standard library's quicker expressions; None if it holds classes that aren't known here."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)
    space, known = "\t\n\x0b\x0c\r \x85\xa0", {r"\p{L}": of("L"), r"\p{N}": of("N")}
    p = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{known[r'\p{L}']}{known[r'\p{N}']}]")
    for name, chars in known.items():
        p = p.replace(name, f"[{chars}]")
    p = p.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    return None if r"\p" in p else re.compile(p).findall


_WIDE = re.compile("[^\x00-\u024f]")


def vocab_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Ids and bytes of words, by a database in memory."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        ranks = ranks_of(path)
        self.any_words, self.latin_words = regex.compile(pattern).findall, narrow(pattern)
        self.kept: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        char = {r: chr(CHAR + r) for r in ranks.values()}
        pairs, made, key = [], [], []
        for t, r in ranks.items():
            ways = 0
            for i in range(1, len(t)):
                x, y = ranks.get(t[:i]), ranks.get(t[i:])
                if x is not None and y is not None:
                    pairs.append(char[x] + char[y]), made.append(char[r]), key.append(r << 10 | ways)  # a pair's rank is that of the bytes it makes
                    ways += 1
        self.con.register("pairs", pa.table({"pair": pairs, "made": made, "key": key}))
        # Bytes are shown as the characters of the same numbers.
        self.con.register("whole", pa.table({"t": list(ranks.values()), "bytes": [t.decode("latin-1") for t in ranks]}))
        self.con.execute("create table merges as select * from pairs")
        self.con.execute("create table vocab as select * from whole")
        self.first = {b: char[ranks[bytes([b])]] for b in range(256)}

    def words(self, text: str) -> list[str]:
        return self.any_words(text) if self.latin_words is None or _WIDE.search(text) else self.latin_words(text)

    def merge(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        """By the recursive query: each word's ids joined by commas, and the bytes they decode to."""
        self.con.register("fresh", pa.table({"w": np.arange(len(words), dtype=np.int32), "s": [w.decode("latin-1").translate(self.first) for w in words]}))
        self.con.register("merged", self.con.sql(RECURSION).to_arrow_table())
        ids = self.con.sql(IDS).to_arrow_table().column("ids").to_pylist()
        raw = self.con.sql(DECODE).to_arrow_table().column("bytes").to_pylist()
        return list(zip(ids, [x.encode("latin-1") for x in raw]))

    def learn(self, segments) -> dict[str, tuple[str, bytes]]:
        """(ids joined by commas, bytes) of segments, through their words."""
        parts = {s: self.words(s) for s in segments}
        new = list({w for ws in parts.values() for w in ws} - self.kept.keys())
        found: dict[str, tuple[str, bytes]] = {}
        for i in range(0, len(new), BATCH):
            part = new[i : i + BATCH]
            found.update(zip(part, self.merge([w.encode("utf-8", "surrogatepass") for w in part])))
        kept, out = self.kept, {}
        for s, ws in parts.items():
            if len(ws) == 1:
                w = ws[0]
                out[s] = found[w] if w in found else kept[w]
            else:
                x = [found[w] if w in found else kept[w] for w in ws]
                out[s] = (",".join([y[0] for y in x]), b"".join([y[1] for y in x]))
        return out

    def __call__(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """n_tokens, hash of the ids, hash of the decoded bytes."""
        if len(self.kept) > KEPT:
            self.old, self.kept = self.kept, {}
        split, need = [], set()
        for t in texts:
            if not t:
                x = []
            elif _AWKWARD.search(t):
                x = [t] if len(t) <= SEGMENT else self.words(t)
            else:
                x = t.replace(" ", "\0 ").split("\0") if "\0" not in t else re.split("(?= )", t)
                if not x[0]:
                    del x[0]
            split.append(x)
            need.update(x)
        kept = self.kept
        need = need.difference(kept)
        again = need & self.old.keys() if self.old else set()
        kept.update((s, self.old[s]) for s in again)
        new = need - again
        kept.update(self.learn(new))
        out = []
        for x in split:
            ids, raw, n = hashlib.sha256(), hashlib.sha256(), 0
            for at in range(0, len(x), 50_000):
                i, r = zip(*map(kept.__getitem__, x[at : at + 50_000]))
                i = ",".join(i)
                n += i.count(",") + 1
                ids.update((b"," if at else b"") + i.encode())
                raw.update(b"".join(r))
            out.append((n, ids.hexdigest(), raw.hexdigest()))
        for s in new:
            if len(s) > SEGMENT:
                del kept[s]
        return out

    def encode(self, text: str | None) -> list[int]:
        ws = self.words(text or "")
        found = self.learn(set(ws))
        return [int(i) for w in ws for i in found[w][0].split(",") if i]

    def decode(self, ids) -> bytes:
        """By the same aggregation; an id out of the vocabulary has no bytes."""
        ids = list(ids)
        if not ids:
            return b""
        self.con.register("merged", pa.table({"w": pa.array([0], pa.int32()), "t": pa.array([ids], pa.list_(pa.int64()))}))
        got = self.con.sql(DECODE).fetchall()
        return got[0][1].encode("latin-1") if got else b""


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = path or vocab_path(), pattern or _pattern()

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            texts, got = b.column("text").to_pylist(), []
            for i in range(0, len(texts), 2500):
                got += c(texts[i : i + 2500])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and the list of ids of each row's text."""
    path, pattern = path or vocab_path(), pattern or _pattern()

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def query(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
