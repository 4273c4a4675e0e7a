"""Word repeats by prefix-partitioned suffix trees.

The suffixes at anchors (see ``repeats``) are partitioned by prefix into groups that fit in memory: by the first words
of every suffix, and where a group still holds different continuations, by longer and longer prefixes inside its bucket.
Each bucket builds the subtrees of its prefixes: a subtree is the sorted list of its leaves with the depths of the
nodes between neighbours; leaves below one node of depth ``MIN_WORDS`` or more are a repeat, and longer matches are deeper
nodes. A prefix that occurs once is a leaf at once and is dropped.

Defined results: a null text has no words; fewer than MIN_WORDS words have no window; rows with equal doc_id stand at
the same place in the order, so none of them is earlier than another; a null doc_id comes before all others; an empty
table gives no rows; texts of any length and self-overlapping repeats are handled whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scrubline.llm import repeats
from scrubline.llm.repeats import Fragments, Windows

MIN_WORDS = 20


def windows(min_words: int = MIN_WORDS) -> Windows:
    width = max(1, min_words * 7 // 10)
    return Windows(min_words, width, max(1, min(3, min_words - width + 1)), repeats.word_symbols, True)


def subtrees(parts: list[Fragments], w: Windows) -> tuple[Fragments, np.ndarray, np.ndarray, np.ndarray]:
    """The leaves of all subtrees of a bucket: (fragments, leaves in order, subtree, depth of the node to the leaf before).

    A group of leaves that share a prefix is split by its next word, as long as it has more than one leaf.
    """
    f = Fragments.join(parts)
    begin = f.offset + f.left + w.prefix
    length = f.offset + f.size - begin
    leaves = np.argsort(f.prefix, kind="stable")
    tree = np.cumsum(np.concatenate([[False], np.diff(f.prefix[leaves]) != 0]))
    depth = np.where(np.concatenate([[False], np.diff(tree) == 0]), -1, 0).astype(np.int64)
    todo = [np.flatnonzero(np.bincount(tree)[tree] > 1)]
    node = tree.copy()
    level = 0
    while len(todo[0]):
        at = todo.pop()
        own = leaves[at]
        has = length[own] > level
        word = np.where(has, f.symbols[np.minimum(begin[own] + level, len(f.symbols) - 1)], 0)
        by = np.lexsort((word, has, node[at]))  # a leaf that ends here comes before those that go on
        leaves[at] = own[by]
        word, has = word[by], has[by]
        inside = np.concatenate([[False], node[at][1:] == node[at][:-1]])
        cut = at[inside & np.concatenate([[False], (word[1:] != word[:-1]) | (has[1:] != has[:-1]) | ~has[1:]])]
        depth[cut] = w.prefix + level
        starts = np.concatenate([[True], node[1:] != node[:-1]])
        starts[cut] = True
        node = np.cumsum(starts) - 1
        level += 1
        todo = [np.flatnonzero(np.bincount(node)[node] > 1)]
    return f, leaves, tree, depth


def repeated_words(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, spans) of each row of docs: the word spans that windows with an earlier start cover."""
    texts = repeats.keyed_texts(docs)
    return repeats.with_spans(texts, repeats.repeated_spans(texts, windows(min_words), subtrees))


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cutter(with_text: bool):
    schema = _CUT if with_text else pa.schema(list(_CUT)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = (text.as_py() or b"").split()
                gone = repeats.covered(len(words), spans.values if spans.is_valid else None)
                kept = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
                row = (doc_id.as_py(), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace") if with_text else None)
                for column, v in zip(out, row):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def remove_repeated_words(docs: DataFrame, min_words: int = MIN_WORDS, with_text: bool = True) -> DataFrame:
    """CUT of each row of docs; without ``with_text`` the kept words stay behind."""
    schema = CUT if with_text else CUT.removesuffix(", kept string")
    return repeated_words(docs, min_words).mapInArrow(_cutter(with_text), schema)


def op2_prefix_suffix_trees(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS k FROM d, unnest(range(1, len(w) - 18)) AS t(i)
), f AS (
  SELECT doc_id, i FROM x QUALIFY (doc_id, i) <> min((doc_id, i)) OVER (PARTITION BY k)
), gone AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM f, unnest(range(0, 20)) AS u(j)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
