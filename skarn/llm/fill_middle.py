"""Fill-in-the-middle: documents rewritten as prefix, suffix and middle, for training on infilling.

A text is cut into units, runs of ASCII letters or single other characters. Four numbers from a hash of the document's id
choose two cuts among the units' ends, whether the document stays plain, and the order of the parts. A text that holds one
of the three marks stays plain, so what was written can always be taken apart again.

A batch of texts goes through a pandas UDF; the ends of one text's units are a compact array of machine integers, and
only the two that are looked up matter.

Defined results: a null or empty text is plain and empty, of no units; a null id hashes like an empty one; ids that are no
integers hash by their text; repeated rows give equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import pick

#: A unit, the marks of prefix, suffix and middle, the share of documents that are rewritten, and of those suffix first, in hundredths.
UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
REWRITTEN, SUFFIX_FIRST = 90, 20
SEED = "1"


def numbers(seed: str, key: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16), int(digest[16:24], 16), int(digest[24:32], 16)


def rewrite(text: str, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output) of a text."""
    ends = array("I", [0])
    ends.extend(m.end() for m in UNIT.finditer(text))
    n = len(ends) - 1
    if not n or draws[2] % 100 >= REWRITTEN or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    a, b = ends[min(one, two)], ends[max(one, two)]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``rewrite`` was given. No mark occurs in its parts, nor across their ends, as no mark starts like it ends."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at, last = output.index(second, len(first)), output.rindex(MIDDLE)
    one, two, middle = output[len(first) : at], output[at + len(second) : last], output[last + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every document.

    With ``digests``, output_sha256 and restored_sha256 (of the text rebuilt from output and form) take the output's place.
    """
    shown = "output_sha256 string, restored_sha256 string" if digests else "output string"

    @F.pandas_udf(f"n long, form string, prefix_chars long, middle_chars long, {shown}")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in parts:
            rows = [rewrite(t, numbers(seed, k)) for k, t in zip(keys, texts, strict=True)]
            made = pd.DataFrame(
                {
                    "n": [r[0] for r in rows],
                    "form": [r[1] for r in rows],
                    "prefix_chars": pd.array([r[2] for r in rows], "Int64"),
                    "middle_chars": pd.array([r[3] for r in rows], "Int64"),
                }
            )
            if digests:
                made["output_sha256"] = [_digest(r[4]) for r in rows]
                made["restored_sha256"] = [_digest(restore(r[4], r[1])) for r in rows]
            else:
                made["output"] = [r[4] for r in rows]
            yield made

    slim = pick(docs, id=id_col, text=text_col)
    made = slim.select("id", cut(F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("made"))
    return made.select("id", "made.*")
