"""SQL names of the engine's functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from scrubline.functions import sniff
from scrubline.functions.hidden import CharacterPass, character_pass
from scrubline.functions.text import TextOptions
from scrubline.operators.blocks import PARSED, detect, parse_rows
from scrubline.operators.strip import OUTCOME, strip_rows

#: Bytes that tell a format.
HEAD = sniff.HEAD_BYTES


def register(spark: SparkSession) -> None:
    """sniff_format, media_blocks and media_strip of binaries and hidden_pass of strings as functions over Arrow batches,
    find_hidden(string) as a table function: ``SELECT d.doc_id, h.* FROM documents d, LATERAL find_hidden(d.text) h``.

    media_blocks gives the blocks that findings are made of; findings and whole text cleaning are expressions
    (``findings.scan``, ``sanitize.clean_text``) and have no SQL name.
    """

    def formats(contents: pa.Array) -> list:
        return [None if x is None else detect(x[:HEAD]) for x in contents.to_pylist()]

    @F.arrow_udf("string")
    def sniff_format(contents: pa.Array) -> pa.Array:
        return pa.array(formats(contents), pa.string())

    @F.arrow_udf(PARSED)
    def media_blocks(contents: pa.Array) -> pa.Array:
        return parse_rows(contents.to_pylist(), formats(contents))

    @F.arrow_udf(OUTCOME)
    def media_strip(contents: pa.Array) -> pa.Array:
        return strip_rows(contents.to_pylist(), formats(contents))

    for name, function in (("sniff_format", sniff_format), ("media_blocks", media_blocks), ("media_strip", media_strip), ("hidden_pass", character_pass(TextOptions()))):
        spark.udf.register(name, function)

    @F.udtf(returnType="cp_start int, code_point int, issue string")
    class FindHidden:
        def eval(self, text: str):
            from collections import Counter

            found: list = []
            if text is not None:
                CharacterPass(TextOptions()).once(text, Counter(), Counter(), found)
            yield from found

    spark.udtf.register("find_hidden", FindHidden)
