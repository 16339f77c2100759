"""Fill-in-the-middle forms of texts, cut at line ranks found in an indexable skip list."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Marks of the three parts: prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


class LineIndex:
    """An indexable skip list over the lines of one text.

    The bottom lane has one link per line. An express lane keeps about a quarter of the nodes
    of the lane below it; each of its links carries how many lines and how many code points
    it passes over, and `base[i]`, the node below its i-th node. Heights come from a hash of
    the line number, so the list of a text is always the same one.
    """

    def __init__(self, widths: Sequence[int]):
        self.lines = len(widths)
        units, chars, ends, base = [1] * len(widths), list(widths), range(1, len(widths) + 1), None
        self.lanes = [(units, chars, base)]
        while len(units) > 1:
            level, up = len(self.lanes), ([], [], [], [0])
            n = c = 0
            for i, end in enumerate(ends):
                n, c = n + units[i], c + chars[i]
                if self._height(end) >= level:
                    up[0].append(n), up[1].append(c), up[2].append(end), up[3].append(i + 1)
                    n = c = 0
            if not up[0]:
                break
            units, chars, ends, base = up
            self.lanes.append((units, chars, base))

    @staticmethod
    def _height(node: int) -> int:
        """How many express lanes a node is in: at least k with a chance of 4 to the power -k."""
        return (32 - (node * 2654435761 & 0xFFFFFFFF).bit_length()) // 2

    def chars_before(self, rank: int) -> int:
        """Code points of the first `rank` lines, by going down the lanes."""
        node = lines = width = 0
        for units, chars, base in reversed(self.lanes):
            while node < len(units) and lines + units[node] <= rank:
                lines, width, node = lines + units[node], width + chars[node], node + 1
            node = base[node] if base else node
        return width


def cut_at(text: str, first: int, second: int) -> tuple[int, int, int]:
    """(lines, code points before the smaller rank, code points between the ranks); ranks are taken modulo lines + 1."""
    index = LineIndex([m.end() - m.start() for m in _LINE.finditer(text)])
    low, high = sorted((first % (index.lines + 1), second % (index.lines + 1)))
    start = index.chars_before(low)
    return index.lines, start, index.chars_before(high) - start


def _draws(seed: int) -> list[Column]:
    """Four numbers below 2**32 per extract: the first 8-digit groups of the SHA-256 of `seed:extract_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("extract_id").cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_middle(extracts: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(extract_id, n_lines, form, prefix_chars, middle_chars, output) per row of `extracts` (extract_id, text).

    The texts meant are those of map elements (`sources.element_texts`). A text is cut after
    two of its 0 to n lines, drawn by its id: `psm` writes prefix, suffix, middle and `spm`
    suffix, prefix, middle, each part behind its mark. `rate` and `spm_rate` are per cent of
    the texts. A text that is null, empty or holds a mark stays `plain`: its output is the
    text (null: empty), and the widths are null. A line ends with its line feed; widths count
    code points; whole texts are cut, however long. Rows are judged one by one, so repeated
    rows give repeated results, a null id draws like the id `null`, other columns are
    ignored, and an empty table gives an empty one. Nothing is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h1, h2, h3, h4 = _draws(seed)
    marked = F.lit(False)
    for s in sentinels:
        marked = marked | F.contains(text, F.lit(s))
    form = (F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm"))

    @F.pandas_udf("n bigint, prefix_chars bigint, middle_chars bigint")
    def cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut_at(t, a, b) for t, a, b in zip(texts, first, second)], columns=["n", "prefix_chars", "middle_chars"], dtype="int64")

    found = extracts.select("extract_id", text.alias("_text"), form.alias("form"), cuts(text, h1, h2).alias("_cut"))
    p, s, m = (F.lit(x) for x in sentinels)
    start, width = F.col("_cut.prefix_chars").cast("int"), F.col("_cut.middle_chars").cast("int")
    prefix, middle = F.substring("_text", F.lit(1), start), F.substring("_text", start + 1, width)
    suffix = F.substring("_text", start + width + 1, F.char_length("_text"))
    output = (F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("_text")))
    shown = lambda c: F.when(F.col("form") != "plain", F.col(f"_cut.{c}")).alias(c)
    return found.select("extract_id", F.col("_cut.n").alias("n_lines"), "form", shown("prefix_chars"), shown("middle_chars"), output.alias("output"))


def restore_texts(outputs: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """`outputs` (form, output) with `text`, the original rebuilt from the two alone.

    No part of a cut text holds a mark and no mark overlaps itself, so each mark is found at
    its first place. A row with another form or a null output has a null text.
    """
    p, s, m = sentinels
    body, middle = F.substring_index("output", m, 1), F.substring_index("output", m, -1)

    def halves(first: str, second: str) -> tuple[Column, Column]:
        one = F.substring_index(body, second, 1)
        return F.substring(one, F.lit(len(first) + 1), F.char_length(one)), F.substring_index(body, second, -1)

    prefix, suffix = halves(p, s)
    last, head = halves(s, p)
    return outputs.withColumn("text", F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(prefix, middle, suffix))
                              .when(F.col("form") == "spm", F.concat(head, middle, last)))
