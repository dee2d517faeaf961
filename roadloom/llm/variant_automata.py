"""Operator 11, spelling variant grouping with forward and backward minimal acyclic automata.

Two words are near if one edit (a code point inserted, deleted or replaced) turns one into the other. Halve a word: either its near
word begins with the first half, or it ends with the second one. So words are kept in two automata, one of the words and one of the
words reversed, both minimal and acyclic. A search matches a half exactly and completes the rest with one error; the numbers
that lead along the path (each edge knows how many words lie before it) are the number of the word that is found, and what belongs
to a word stands in an array under its number. What both directions find is counted once.

Spark deals the words by their halves: a word goes to the halves by which words one shorter, as long, or one longer may ask for it
(two a direction), and asks by its own. A half that many words share is cut into parts of both sides, which meet each other part
by part, so that an automaton and the words that ask it have a bounded size.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import cut, need, read, written

LEAST_CHARS, LEAST_TIMES, RATIO = 7, 2, 10
#: Words of an automaton, about: so many rows are dealt to a shard, and a half with more of them is cut into parts.
SHARD_ROWS = 40_000


class Automaton:
    """The minimal acyclic automaton of words that come in order and are distinct. Each node's edges lead, by a character, to a node
    and to the number of the node's words that lie before those of the edge: the sum along a path is the word's place in the order."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[dict[str, int]] = [{}]  # edges of the nodes along the last word, which may still get more
        ends, before = [False], ""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                node = self._node(path.pop(), ends.pop(), known)
                path[-1][before[len(path) - 1]] = node

        for word in words:
            k, most = 0, min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            settle(k)
            for _ in range(len(word) - k):
                path.append({})
                ends.append(False)
            ends[-1], before = True, word
        settle(0)
        self.root = self._node(path[0], ends[0], known)

    def _node(self, children: dict[str, int], final: bool, known: dict[tuple, int]) -> int:
        key = (final, *children.items())
        if key not in known:
            edges, passed = {}, int(final)
            for c, child in children.items():
                edges[c] = (child, passed)
                passed += self._size[child]
            known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final)
            self._size.append(passed)
        return known[key]

    def number(self, node: int, word: str, at: int) -> int:
        """The number, among the node's words, of what stands from `at` on; -1 if it is none of them."""
        edges, total = self.edges, 0
        for k in range(at, len(word)):
            hit = edges[node].get(word[k])
            if hit is None:
                return -1
            node = hit[0]
            total += hit[1]
        return total if self.final[node] else -1

    def one_edit(self, word: str, exact: int) -> list[int]:
        """Numbers of the words that begin as the word does, so many characters, and differ from it by exactly one edit. Each comes
        once: of the edits with the same result only the last of a run of equal characters is made."""
        node, number, found = self.root, 0, []
        for k in range(exact):
            hit = self.edges[node].get(word[k])
            if hit is None:
                return found
            node = hit[0]
            number += hit[1]
        for k in range(exact, len(word) + 1):
            own = word[k] if k < len(word) else None
            here = self.edges[node]
            for c, (child, passed) in here.items():
                if c != own:
                    for rest in (k,) if own is None else (k, k + 1):  # c inserted, c in the place of own
                        m = self.number(child, word, rest)
                        if m >= 0:
                            found.append(number + passed + m)
            if own is None:
                break
            if k + 1 == len(word) or word[k + 1] != own:
                m = self.number(node, word, k + 1)  # own deleted
                if m >= 0:
                    found.append(number + m)
            hit = here.get(own)
            if hit is None:
                break
            node = hit[0]
            number += hit[1]
        return found


def near_of(words: list[str], times: list[int], asking: list[str], backward: bool) -> tuple[list[int], list[int | None], list[str | None]]:
    """For each asking word the number of near words among the words (distinct, in any order), the most times that one of them
    occurs, and the first of those that do. Forward: the near words that begin with the first half; backward: those that end with the
    second half and don't begin with the first."""
    turned = [w[::-1] for w in words] if backward else words
    order = sorted(range(len(words)), key=turned.__getitem__)
    automaton = Automaton([turned[i] for i in order])
    many, most, first = [], [], []
    for word in asking:
        half = len(word) // 2
        found = automaton.one_edit(word[::-1], len(word) - half) if backward else automaton.one_edit(word, half)
        near = [order[k] for k in found]
        if backward:
            near = [i for i in near if not words[i].startswith(word[:half])]
        best = min(((-times[i], words[i]) for i in near), default=(None, None))
        many.append(len(near))
        most.append(None if best[0] is None else -best[0])
        first.append(best[1])
    return many, most, first


def _halves() -> Column:
    """(backward, half, asks) of a word: the halves by which words of its own and of neighbouring lengths look for it."""
    n = F.length("word")
    own = F.floor(n / 2).cast("int")
    other = own + F.when(n % 2 == 0, -1).otherwise(1)
    out = []
    for size, asks in ((own, True), (other, False)):
        out.append(F.struct(F.lit(False).alias("backward"), F.substring(F.col("word"), F.lit(1), size).alias("half"), F.lit(asks).alias("asks")))
        out.append(F.struct(F.lit(True).alias("backward"), F.substring(F.col("word"), size + 1, n).alias("half"), F.lit(asks).alias("asks")))
    return F.array(*out)


def near_words(words: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n; each once, of two characters or more) that have near words: how many, the
    most times that one of them occurs, and the first of those in code-point order."""
    rows = words.select("word", "n", F.explode(_halves()).alias("k")).select("word", "n", "k.backward", "k.asks", F.xxhash64("k.backward", "k.half").alias("h"))
    rows = written(rows, "variant_automata", "halves")
    shards = max(1, -(-rows.count() // shard_rows))
    large = written(rows.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > shard_rows).select("h", F.ceil(F.col("c") / shard_rows).cast("int").alias("parts")), "variant_automata", "large")
    dealt = rows.join(large, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    # a part of those that are found meets each part of those that ask
    cell = lambda number, held, asks: F.struct(number.alias("cell"), F.lit(held).alias("held"), asks.alias("asks"))
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    found = F.transform(each, lambda p: cell(F.col("own") * F.col("parts") + p, True, F.lit(False)))
    asking = F.transform(each, lambda p: cell(p * F.col("parts") + F.col("own"), False, F.lit(True)))
    cells = F.when(F.col("parts") == 1, F.array(cell(F.lit(0), True, F.col("asks")))).when(F.col("asks"), F.concat(found, asking)).otherwise(found)
    dealt = dealt.select("word", "n", "backward", "h", "parts", F.explode(cells).alias("c"))
    # a pair of parts is a group by itself, so that no word is found again through another part or half
    cut_up = F.col("parts") > 1
    dealt = dealt.select("word", "n", "backward", "c.held", "c.asks", F.when(cut_up, F.col("h")).otherwise(F.pmod("h", F.lit(shards))).alias("shard"), F.when(cut_up, F.col("c.cell")).alias("cell"))

    def work(table: pa.Table) -> pa.Table:
        out = {"word": [], "n_near": [], "form_n": [], "form": []}
        for backward in (False, True):
            side = table.filter(pc.equal(table.column("backward"), backward))
            held, asks = side.filter(side.column("held")), side.filter(side.column("asks")).column("word").to_pylist()
            times = dict(zip(held.column("word").to_pylist(), held.column("n").to_pylist(), strict=True))  # a word with two of its halves is one
            # a word that asks is held here with its part, or not at all: it is never near to itself
            many, most, first = near_of(list(times), list(times.values()), asks, backward)
            for word, *found in zip(asks, many, most, first, strict=True):
                if found[0]:
                    for name, value in zip(out, (word, *found), strict=True):
                        out[name].append(value)
        return pa.table({k: pa.array(v, pa.string() if k in ("word", "form") else pa.int64()) for k, v in out.items()})



    some = dealt.groupBy("shard", "cell").applyInArrow(work, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")
    return some.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the chain of forms. A form occurs several times as often as its word, so no chain comes
    back, and chains are short; each round doubles the way that is known."""
    step = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = new.select("word", "root")
        if not new.where("moved").take(1):
            return step


def variants(words: DataFrame, ratio: int = RATIO, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n), one row each. form: of the near words the one that occurs most (ties:
    the smallest in code-point order), if it occurs at least `ratio` times as often, else null; root: the end of the chain of forms, the
    word itself where it has none; n_near: the number of near words."""
    near = near_words(words, shard_rows)
    takes = F.col("form_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n"))
    joined = written(joined, "variant_automata", "forms")
    chain = roots(joined.where("form is not null"))
    return joined.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def counted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, every: int = 31) -> DataFrame:
    """(word, n): the words of all texts, with their occurrences, of so many characters and times at least. A word is a maximal run of
    letters (ASCII, and U+00C0 to U+00FF), with A-Z in lower case. One run in `every`, by the crc32 of `<id>:<run>`, loses the character
    that the crc32 names, as a slip of the pen would; a null id counts as empty. Null texts have no words."""
    d = need(docs, id_column, text_column).select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc"), F.col(text_column).alias("text"))
    # what is shorter before a character is lost is too short after it
    found = d.select("doc", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))).alias("run"))
    found = found.select("doc", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    found = found.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, slip).otherwise(F.col("run"))
    return found.select(word.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)


def op11_variant_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words; repeated rows count as often as they stand; an empty table gives no rows; further columns
    play no part."""
    return variants(written(counted(read(spark, sf_dir, "documents")), "variant_automata", "words"))
