"""Secret scans: three base patterns, and values in credential context that would be costly to guess.

The guess cost of a value is the cheapest way to cut it into ranked words, dates, repeats, keyboard walks, separators and
brute-force spans, in powers of ten: each span costs the logarithm of the guesses for it, and each further span costs
`CHARGE` more. Words are a short list of weak credentials' parts, then the corpus's own most frequent words, counted over
all documents outside credential context. A value in credential context is a secret from `min_cost` on; placeholders
(`changeme`, `12345678`), ordinary words and references in code stay below.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Names beside which a value is a credential, then the value, maybe behind a bearer's word; user:password@ in an address.
NAMED = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|auth(?:orization)?|credentials?|private_?key|access_?key)["']?\x20*[:=]\x20*["']?(?:(?i:bearer|basic)\x20+)?([^\s"'<>@,;]{8,})""",
    re.ASCII,
)
ADDRESS = re.compile(r"""://[^\s/:@]+:([^\s/"'<>@,;]{8,})@""", re.ASCII)
KEYWORDS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "://")

# Frequent parts of weak credentials and of references in code, most frequent first.
WORDS = """password admin user welcome login letmein master secret token test default example changeme change pass root
guest public private key api access hello dragon monkey sunshine princess football baseball shadow iloveyou love god
sample dummy placeholder your here the my not none null true false name value string insert enter todo replace
redacted hidden empty undefined config local dev prod staging demo get set env process self this environ os settings
request params vault getenv""".split()  # fmt: skip
# Rows and columns of keys, and the orders of letters and digits.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "0123456789", "abcdefghijklmnopqrstuvwxyz", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm")
SEPARATORS = "._-/:()"
DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/.]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
LEET = str.maketrans("@310$5!7", "aeiossit")
CHARGE = 0.5
#: Characters of the longest word of the list, date or walk.
LONGEST_WORD = 24
LOOK = max(LONGEST_WORD, 10, *map(len, WALKS))

#: Two keys side by side -> the lines, forward or backward, and the places where they stand so.
STEPS: dict[str, list[tuple[str, int]]] = {}
for _line in {x for row in WALKS for x in (row, row[::-1])}:
    for _at in range(len(_line) - 1):
        STEPS.setdefault(_line[_at : _at + 2], []).append((_line, _at))


def alphabet(value: str) -> int:
    sizes = ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9]", 32))
    return sum(n for kind, n in sizes if re.search(kind, value))


def repeats(value: str) -> Iterator[int]:
    """For each prefix, the length of its longest suffix that also ends earlier in it, by a suffix automaton in linear time.

    While a suffix goes on as at its earlier place, its length grows by one, as it can by no more, and the automaton waits;
    it takes in what it lacks when the two part. A value of one repeated unit never grows it beyond the unit.
    """
    link, length, end, after, last, built, longest, source = [-1], [0], [0], [{}], 0, 0, 0, 0
    for at, char in enumerate(value):
        if longest and value[source] == char:
            longest, source = longest + 1, source + 1
            yield longest
            continue
        for place in range(built, at + 1):
            c, new, p = value[place], len(link), last
            link.append(0)
            length.append(length[last] + 1)
            end.append(place + 1)
            after.append({})
            while p >= 0 and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p >= 0:
                q = after[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    end.append(end[q])
                    after.append(dict(after[q]))
                    while p >= 0 and after[p].get(c) == q:
                        after[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        built, longest, source = at + 1, length[link[last]], end[link[last]]
        yield longest


class Guesser:
    """Guess costs by a ranked list of words, WORDS first."""

    def __init__(self, words: list[str] = ()):
        ranked = dict.fromkeys([*WORDS, *(w for w in words if 2 <= len(w) <= LONGEST_WORD)])
        self.ranks = {word: math.log10(rank + 2) for rank, word in enumerate(ranked)}
        self.openings = {word[:n] for word in ranked for n in range(2, len(word) + 1)}
        self.short = lru_cache(20_000)(self.cost)

    def spans_from(self, value: str, lower: str, plain: str, i: int) -> Iterator[tuple[int, float]]:
        """(end, cost) of the words, dates, walks and separators that start at i; all are LOOK characters long at most."""
        for form, extra in ((lower, 0.0), (plain, 0.5)) if plain != lower else ((lower, 0.0),):
            end = i + 2
            while end <= len(value) and (part := form[i:end]) in self.openings:
                if part in self.ranks:
                    yield end, self.ranks[part] + extra + (0.3 if value[i:end] != lower[i:end] else 0.0)
                end += 1
        if "0" <= value[i] <= "9":
            for end in range(i + 4, min(len(value), i + 10) + 1):
                if DATE.fullmatch(value, i, end):
                    yield end, math.log10(119) if end - i == 4 else math.log10(365 * 119)
        for line, at in STEPS.get(lower[i : i + 2], ()):
            n = 2
            while at + n < len(line) and lower[i + n : i + n + 1] == line[at + n]:
                n += 1
                yield i + n, math.log10(60 * n)
        if value[i] in SEPARATORS:
            yield i + 1, math.log10(len(SEPARATORS))

    def cost(self, value: str, limit: float = math.inf) -> float:
        """Decimal logarithm of the guesses for the cheapest segmentation, or `limit` as soon as none can be cheaper.

        A repeat is a span that also stands earlier in the value (the two may overlap); where and how long are told out of the
        value's length each. Time is linear in the length: other spans are bounded, and a repeat's best start is kept in a queue.
        """
        n = len(value)
        if not n:
            return 0.0
        brute, repeat = math.log10(max(10, alphabet(value))), 2 * math.log10(n) + CHARGE
        lower = value.lower()
        lower = lower if len(lower) == n else value
        plain = lower.translate(LEET)
        best, loose = [math.inf] * (n + 1), [math.inf] * (n + 1)  # cheapest cut of the first i characters; loose: its last span is brute force
        best[0] = -CHARGE
        starts: deque[tuple[int, float]] = deque()  # where a repeat that ends here may begin, cheaper ones last only if later
        for i, longest in enumerate(repeats(value)):
            here = min(best[i], loose[i])
            while starts and starts[-1][1] >= here:
                starts.pop()
            starts.append((i, here))
            if here >= limit and starts[0][1] + repeat >= limit and min(best[i : i + LOOK + 1]) >= limit:
                return limit
            loose[i + 1] = min(best[i] + CHARGE, loose[i]) + brute
            for end, cost in self.spans_from(value, lower, plain, i):
                best[end] = min(best[end], here + CHARGE + cost)
            while starts and starts[0][0] < i + 1 - longest:
                starts.popleft()
            if starts:
                best[i + 1] = min(best[i + 1], starts[0][1] + repeat)
        return min(best[n], loose[n])

    def is_costly(self, value: str, min_cost: float) -> bool:
        return 2 * len(value) >= min_cost and (self.short if len(value) <= 64 else self.cost)(value, min_cost) >= min_cost


def may_hold_hex(data: bytes, table: bytes = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))) -> bool:
    return b"\1" * 16 in data.translate(table)


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values in credential context."""
    for pattern in (NAMED, ADDRESS):
        yield from (m.span(1) for m in pattern.finditer(text))


def may_hold_credential(text: str) -> bool:
    lower = text.lower()
    return any(word in lower for word in KEYWORDS)


def find_secrets(text: str, guesser: Guesser, min_cost: float = 14.0) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in assign, access, hex, guess; code points, end exclusive."""
    found = []
    if may_hold_credential(text):
        found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
        found += [(start, 3, end, "guess") for start, end in set(context_values(text)) if guesser.is_costly(text[start:end], min_cost)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if may_hold_hex(text.encode()):
        found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


#: For bytes.translate: letters stay, all other ASCII to spaces.
LETTERS_ONLY = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def plain_words(text: str) -> list[bytes]:
    """Runs of letters in lower case outside the values in credential context."""
    if may_hold_credential(text):
        at, parts = 0, []
        for start, end in sorted(context_values(text)):
            parts.append(text[at:start])
            at = max(at, end)
        text = " ".join([*parts, text[at:]])
    return text.lower().encode().translate(LETTERS_ONLY).split()


def ranked_words(docs: DataFrame, max_words: int = 20_000, min_count: int = 3) -> list[str]:
    """The corpus's most frequent words of 3 to 24 letters, by count, then alphabet; counted over all whole texts.

    Words of one frequency class (a sixteenth of a doubling; up to 16 each count is its own) come in together or not at all, so
    that ties need no order over all words: the classes from the highest down that hold at most `max_words` together. So no
    more than these reach the driver, after a count for each class. Tasks count on their own before the shuffle: a word of a
    third of all rows is a row a task. Null texts have no words; repeated rows count each; an empty table gives no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            rows = [(w.decode(errors="ignore"), n) for w, n in counts.items() if 3 <= len(w) <= 4 * LONGEST_WORD]
            counts.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in rows], pa.string()), "n": pa.array([n for _, n in rows], pa.int64())})

        for batch in batches:
            for text in common.texts(batch):
                counts.update(plain_words(text))
            if len(counts) > 400_000:
                yield made()
        yield made()

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = common.durable(counted.where((F.col("n") >= min_count) & F.length("word").between(3, LONGEST_WORD)).withColumn("class", F.floor(F.log2("n") * 16)))
    taken, least = 0, None
    for row in sorted(found.groupBy("class").agg(F.count("*").alias("words")).collect(), reverse=True):  # under 1,024 classes
        taken += row.words
        if taken > max_words:
            break
        least = row["class"]
    top = found.where(F.col("class") >= least).select("word", "n").collect() if least is not None else []
    return [r.word for r in sorted(top, key=lambda r: (-r.n, r.word))]


_guessers: dict[int, Guesser] = {}


def guesser_of(key: int, words: list[str]) -> Guesser:
    """The worker's own, kept from task to task."""
    if key not in _guessers:
        _guessers.clear()
        _guessers[key] = Guesser(words)
    return _guessers[key]


def scan(docs: DataFrame, words: list[str] = (), min_cost: float = 14.0) -> DataFrame:
    """doc_id and spans (kind, start, end) of each row, with `words` as ranked_words() gives them; no shuffle.

    Null and empty texts have no spans. Repeated rows and null ids are scanned row by row, further columns are not read,
    an empty table gives no rows; spans that start together stand in the order of kinds. Time grows with the length of a text
    and of its values, however long they are. The words are broadcast: ranked_words() bounds them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    ranked = docs.sparkSession.sparkContext.broadcast(list(words))
    key = ranked._jbroadcast.id() if ranked._jbroadcast is not None else id(ranked)

    def rows(batch: pa.RecordBatch) -> dict:
        guesser = guesser_of(key, ranked.value)
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t, guesser, min_cost)] for t in common.texts(batch)]
        return {"doc_id": batch.column("doc_id"), "spans": pa.array(found, spans)}

    return common.map_batches(docs.select("doc_id", "text"), rows, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = scan(docs, ranked_words(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("spans", lambda s: s.kind != "guess"))
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op4_secret_scans": op4_secret_scans}
