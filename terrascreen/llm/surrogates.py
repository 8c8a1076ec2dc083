"""Personal data replaced by surrogates: keyed, of the same type and format, distinct where the originals were, the same where they were the same."""

import hashlib
import hmac
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.llm.shared import ROW, bundled, written

MAX_ATTEMPTS = 60

#: Given names by script and gender.
GIVEN = {
    "latin-f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Donna Michelle Carol Amanda "
               "Melissa Claire Camille Juliette Sophie Ursula Monika Sabine Katrin Lucía Carmen Pilar Beatriz".split(),
    "latin-m": "James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Andrew Paul "
               "Joshua Pierre Laurent Jacques Mathieu Jürgen Wolfgang Stefan Dieter Carlos Javier Miguel Rafael".split(),
    "cyrillic-f": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    "cyrillic-m": "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Владимир".split(),
    "greek-f": "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
    "greek-m": "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Βασίλης".split(),
}
GROUP_OF = {name: group for group, names in GIVEN.items() for name in names}
SYLLABLES = {"latin": ("b c d f g h k l m n p r s t v w".split(), "a e i o u".split(), ("n", "r", "l", "s", "t", "m")),
             "cyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split(), ("н", "р", "л", "в")),
             "greek": ("β γ δ κ λ μ ν π ρ σ τ".split(), "α ε ι ο".split(), ("ς",))}
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)\.?"
CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯΆ-Ώ]"
NAME = CAPITAL + r"[a-zß-öø-ÿа-яё'’ά-ώ-]+"

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(
    r"(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d))")
LISTED = "|".join(sorted(GROUP_OF, key=len, reverse=True))
PERSON = re.compile(rf"(?:(?P<title>\b{TITLES}\x20)(?P<name>{NAME})|(?<![\w'’-])(?P<first>{LISTED})(?![\w'’-]))(?P<rest>(?:\x20{NAME})*)")
WORD = re.compile(rf"(?<![\w'’-]){NAME}")
PAIR = re.compile(rf"{CAPITAL}\w+\.?\x20{CAPITAL}")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def script_of(word: str) -> str:
    first = ord(word[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin"


def bare(word: str) -> str:
    """A name without a possessive ending."""
    return word[:-2] if len(word) > 3 and word.endswith(("'s", "’s")) else word


def find(text: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, canonical`` of all entities, in order and without overlaps; numbers that fail their checks are none."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            kind, value = m.lastgroup, m[0]
            plain = re.sub(r"[^A-Z0-9]", "", value)
            if kind == "ip":
                if any(int(p) > 255 for p in value.split(".")):
                    continue
                plain = ".".join(str(int(p)) for p in value.split("."))
            elif kind == "iban" and not iban_valid(plain):
                continue
            elif kind == "card" and not (len(plain) == 16 and plain[0] in "3456" or luhn(plain) and plain[0] in "3456"):
                continue
            found.append((m.start(), m.end(), kind, plain))
    if PAIR.search(text):
        surnames = set()
        for m in PERSON.finditer(text):
            if m["title"] or m["rest"]:
                for w in WORD.finditer(text, m.start("name" if m["title"] else "first"), m.end()):
                    word = bare(w[0])
                    if word in GROUP_OF:
                        found.append((w.start(), w.start() + len(word), "given-" + GROUP_OF[word], word))
                    else:
                        found.append((w.start(), w.start() + len(word), "surname-" + script_of(word), word.lower()))
                        surnames.add(word)
        if surnames:
            for w in WORD.finditer(text):
                if (word := bare(w[0])) in surnames:
                    found.append((w.start(), w.start() + len(word), "surname-" + script_of(word), word.lower()))
    found.sort()
    kept, end = [], 0
    for item in found:
        if item[0] >= end:
            kept.append(item)
            end = item[1]
    return kept


class Draw:
    """Endless keyed choices for one value and attempt."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.count, self.pool = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, self.seed + b"\x1f%d" % self.count, hashlib.sha256).digest()
            self.count += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, text: str) -> str:
        """Digits for digits and letters for letters; other signs stay."""
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if "a" <= c <= "z" else chr(65 + self.below(26)) if "A" <= c <= "Z" else c for c in text)


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of a canonical value: same kind, same shape, checks kept.

    Addresses and surnames grow with the attempts, so there are always enough of them.
    """
    draw, longer = Draw(key, kind, value, attempt), attempt // 4
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        fixed = 2 if labels[-2] == "example" else 1
        return draw.like(local) + draw.like("x" * longer) + "@" + ".".join([*map(draw.like, labels[:-fixed]), *labels[-fixed:]])
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        body = value[0] + draw.like(value[1:-1])
        if not luhn(value):
            return body + draw.like(value[-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        body = draw.like(value[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "phone":
        fixed = 1 if len(value) > 10 else 0
        return value[:fixed] + draw.like(value[fixed:])
    if kind == "ssn":
        return draw.like(value)
    if kind.startswith("given-"):
        names = GIVEN[kind.removeprefix("given-")]
        ring = sorted(names, key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
        return ring[(ring.index(value) + 1) % len(ring)]
    onsets, vowels, ends = SYLLABLES[kind.removeprefix("surname-")]
    size = max(2, min(4, len(value) // 3)) + longer
    return "".join(onsets[draw.below(len(onsets))] + vowels[draw.below(len(vowels))] for _ in range(size)) + ends[draw.below(len(ends))]


def dressed(kind: str, mention: str, value: str) -> str:
    """A canonical surrogate in the dress of the mention it replaces: its signs and spaces, its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(value)
        return "".join(next(signs) if c.isalnum() else c for c in mention)
    if kind == "email":
        return "@".join(new.upper() if old.isupper() else new for old, new in zip(mention.split("@"), value.split("@")))
    if kind.startswith("surname-"):
        return value.upper() if mention.isupper() else value[:1].upper() + value[1:]
    return value


MENTIONS = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def mentions(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of ``keep``), ``text`` and ``mentions`` of every whole text."""
    source = bundled(docs, text, keep)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))
        for batch in batches:
            found = [[dict(zip(("start", "end", "kind", "value"), m)) for m in find(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("text"), pa.array(found, kind)], [ROW, "text", "mentions"])

    return source.mapInArrow(detect, f"{ROW} {source.schema[ROW].dataType.simpleString()}, text string, mentions {MENTIONS}")


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, surrogate`` for distinct ``kind, value``: no two of a kind share a surrogate, and none is an original of the corpus.

    Values whose candidate is taken or real draw again; of several that drew the same one the smallest keeps it.
    """
    def draw(attempt: int):
        @F.pandas_udf("string")
        def candidates(kind: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series([surrogate(k, v, attempt, key) for k, v in zip(kind, value)], dtype=object)
        return candidates

    is_given = F.col("kind").startswith("given-")
    done = entities.where(is_given).withColumn("surrogate", draw(0)("kind", "value"))
    waiting = entities.where(~is_given)
    real = waiting.select("kind", F.col("value").alias("surrogate"))
    settled = None
    for attempt in range(MAX_ATTEMPTS):
        drawn = written(waiting.withColumn("surrogate", draw(attempt)("kind", "value")), "surrogate-draws")
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        winners = written(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"), "surrogates")
        settled = winners if settled is None else settled.unionByName(winners)
        waiting = drawn.select("kind", "value").join(winners.select("kind", "value"), ["kind", "value"], "left_anti")
        if waiting.isEmpty():
            return settled.unionByName(done)
    raise ValueError(f"some values found no free surrogate in {MAX_ATTEMPTS} attempts")


def replaced(docs: DataFrame, key: bytes, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``text`` with surrogates, and ``entities`` (``start, end, kind`` in the original).

    Equal values have equal surrogates all over the table; a title and a surname agree with the full name elsewhere, since given names and
    surnames are replaced each by itself. A null text counts as empty; texts without entities come back as they are.
    """
    found = written(mentions(docs, text, keep).withColumn("at", F.monotonically_increasing_id()), "mentions")
    held = found.where(F.size("mentions") > 0)
    each = held.select("at", F.explode("mentions").alias("m")).select("at", "m.*")
    table = assigned(written(each.select("kind", "value").distinct(), "entities"), key)
    swaps = (each.join(table, ["kind", "value"]).groupBy("at")
             .agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("swaps")))

    @F.pandas_udf("string")
    def swap(text: pd.Series, swaps: pd.Series) -> pd.Series:
        out = []
        for t, list_ in zip(text, swaps):
            parts, at = [], 0
            for s in list_:
                parts += [t[at:s["start"]], dressed(s["kind"], t[s["start"]:s["end"]], s["surrogate"])]
                at = s["end"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    entities = F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind")))
    changed = held.join(swaps, "at").select(ROW, swap("text", "swaps").alias("text"), entities.alias("entities"))
    same = found.where(F.size("mentions") == 0).select(ROW, "text", entities.alias("entities"))
    return changed.unionByName(same).select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in keep if c not in ("text", "entities")], "text", "entities")
