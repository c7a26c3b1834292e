"""Secret scans: named patterns plus sliding-window entropy (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import bound, text_of

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: kind -> (pattern, cheap test that some match may exist). For access and hex the length is part of the pattern: their
#: runs are maximal, so the leftmost long run is what dropping short matches would leave.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Character classes of the entropy scan: name, alphabet, window, bits per character that a window must reach.
CLASSES = (
    ("entropy_hex", "0123456789ABCDEFabcdef", 24, 3.2),
    ("entropy_base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-", 24, 4.05),
)
#: The entropy scan passes over windows in which one of these is found, and over runs that one of them matches as a whole.
ALLOW = (
    r"(?i)example|placeholder|changeme|dummy|sample|xxxx",
    r"^[a-z_-]+$|^[A-Z_-]+$|^[0-9_-]+$",
    r"(?i)abcdefgh|01234567",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Scale of the integer table of c * log2(c), so that sums are exact in any order.
SCALE = 1_000_000
#: Pieces of a text, and window starts of a candidate, that are handled as one block.
BLOCK, CHUNK = 64, 128


def entropy_table(window: int) -> list[int]:
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def entropy_limit(window: int, bits: float) -> int:
    """A window's entropy is log2(w) - sum(c log2 c) / w: it is at least `bits` when the sum is at most this."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of a pattern's leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves alternate, so running lengths give the positions. They run
    inside blocks of BLOCK pieces first and then over the blocks, so that no array grows with all of a text's matches.
    """
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    kind = "array<struct<start:bigint,end:bigint,hit:string>>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        found = F.when(x["hit"].isNull(), state["found"]).otherwise(
            F.concat(state["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))).cast(kind))
        )
        return F.struct(end.alias("at"), found.alias("found"))

    def blocks(ps: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("found"))
        return F.transform(F.sequence(F.lit(1), F.size(ps), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(ps, i, F.lit(BLOCK)), start, step))

    def placed(bs: Column) -> Column:
        offsets = F.aggregate(bs, F.array(F.lit(0).cast("long")), lambda o, b: F.concat(o, F.array(F.element_at(o, -1) + b["at"])))

        def moved(os: Column) -> Column:
            return F.flatten(
                F.transform(
                    bs,
                    lambda b, k: F.transform(
                        b["found"],
                        lambda m: F.struct((m["start"] + F.get(os, k)).alias("start"), (m["end"] + F.get(os, k)).alias("end"), m["hit"].alias("hit")),
                    ),
                )
            )

        return bound(offsets, moved)

    return F.when(F.regexp_like(text, F.lit(pattern)), bound(bound(pairs, blocks), placed)).otherwise(F.array().cast(kind))


def window_spans(token: Column, alphabet: str, window: int, bits: float, allow: str = "") -> Column:
    """array<struct<start, end>> (from 0): the joined windows of a candidate whose entropy reaches `bits` and in which
    the pattern `allow`, if any, is not found.

    A candidate is cut into chunks of CHUNK window starts, each with the window - 1 letters that follow, so every window
    lies in one chunk and time grows in proportion to the length. In a chunk the window's counts live in a string with one
    character per letter of the alphabet, and its sum of c log2 c is carried along: a step touches the count of the letter
    that comes in and of the one that goes out. Windows that touch are joined within and then across chunks.
    """
    table = F.array(*map(F.lit, entropy_table(window)))
    zero = 48
    kind = "array<struct<start:bigint,end:bigint>>"
    chunks = F.regexp_extract_all(token, F.lit(f"(?=(.{{1,{CHUNK + window - 1}}})).{{1,{CHUNK}}}"), F.lit(1))

    def moved(s: Column, place: Column, by: int) -> Column:
        """The state after the count of one letter changed."""
        n = F.ascii(F.substr(s["counts"], place, F.lit(1))) - zero
        return bound(
            n,
            lambda n: F.struct(
                F.overlay(s["counts"], F.char(n + (zero + by)), place, F.lit(1)).alias("counts"),
                (s["sum"] + F.get(table, n + by) - F.get(table, n)).alias("sum"),
                s["found"].alias("found"),
            ),
        )

    def join(s: Column, i: Column, chunk: Column) -> Column:
        start, end = (i - (window - 1)).cast("long"), (i + 1).cast("long")
        last = F.get(s["found"], F.size(s["found"]) - 1)
        grown = F.when(
            (F.size(s["found"]) > 0) & (last["end"] >= start),
            F.concat(F.slice(s["found"], F.lit(1), F.size(s["found"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))).cast(kind)),
        ).otherwise(F.concat(s["found"], F.array(F.struct(start.alias("start"), end.alias("end"))).cast(kind)))
        hit = (i >= window - 1) & (s["sum"] <= entropy_limit(window, bits))
        if allow:
            hit &= ~F.regexp_like(F.substr(chunk, i - (window - 2), F.lit(window)), F.lit(allow))
        return F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), F.when(hit, grown).otherwise(s["found"]).alias("found"))

    start = F.struct(
        F.lit(chr(zero) * len(alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.array().cast(kind).alias("found")
    )

    def chunk_spans(places: Column, chunk: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            left = bound(s, lambda x: F.when(i >= window, moved(x, F.get(places, i - window), -1)).otherwise(x))
            entered = bound(left, lambda x: moved(x, F.get(places, i), 1))
            return bound(entered, lambda x: join(x, i, chunk))

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda s: s["found"])

    def spans(chunk: Column, k: Column) -> Column:
        places = F.transform(F.regexp_extract_all(chunk, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(alphabet), c))
        at = k.cast("long") * CHUNK
        return F.transform(bound(places, lambda ps: chunk_spans(ps, chunk)), lambda w: F.struct((w["start"] + at).alias("start"), (w["end"] + at).alias("end")))

    def joined(every: Column) -> Column:
        """Spans by start, ends rising: a joined one begins where none before touches and ends where none after does."""
        before = lambda i: F.get(every, i - 1)["end"]
        after = lambda i: F.get(every, i + 1)["start"]
        firsts = F.filter(every, lambda s, i: before(i).isNull() | (before(i) < s["start"]))
        lasts = F.filter(every, lambda s, i: after(i).isNull() | (after(i) > s["end"]))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    return bound(F.flatten(F.transform(chunks, spans)), joined)


def _placed(alphabet: str, window: int, bits: float, allow: str):
    """From a match to its entropy spans in the text's positions."""

    def placed(m: Column) -> Column:
        return F.transform(
            window_spans(m["hit"], alphabet, window, bits, allow),
            lambda w: F.struct((m["start"] + w["start"]).alias("start"), (m["start"] + w["end"]).alias("end")),
        )

    return placed


def scan_secrets(docs: DataFrame, classes=CLASSES, allow: tuple[str, ...] = ALLOW, min_value: int = 6) -> DataFrame:
    """One row per input row: doc_id, spans array<struct<start, kind_no, end, kind>> in text order.

    Named kinds: assign (a keyword, a separator and a value of `min_value` characters or more), access and hex. The
    entropy kinds are windows of maximal runs of a character class whose Shannon entropy reaches the class's limit,
    joined where they touch. A window in which an allow-list pattern is found does not count, nor does a run that a
    pattern matches as a whole; the other windows around such a window do. Named kinds are never suppressed.
    Positions are code points, ends exclusive. Work is row-local: no shuffle, and a text's scan ends at a plain test
    when it has no match of a kind.

    Null or empty text has no spans. Ids may be null or repeat. An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    text = text_of()
    value = lambda hit: F.regexp_extract(hit, ASSIGN, 2)
    named = [
        (0, F.filter(matches(text, ASSIGN), lambda m: F.char_length(value(m["hit"])) >= min_value)),
        (1, matches(text, ACCESS)),
        (2, matches(text, HEX)),
    ]

    def tagged(found: Column, no: int, kind: str) -> Column:
        return F.transform(
            found,
            lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind")),
        ).cast(SPAN)

    parts = [tagged(found, no, KINDS[no]) for no, found in named]
    for no, (kind, alphabet, window, bits) in enumerate(classes, len(named)):
        run = "[" + alphabet.replace("-", "\\-") + f"]{{{window},}}"
        found, listed = matches(text, run), "|".join(f"(?:{a})" for a in allow)
        if allow:
            found = F.filter(found, lambda m: ~F.regexp_like(m["hit"], F.lit(f"^(?:{listed})$")))  # noqa: B023
        parts.append(tagged(F.flatten(F.transform(found, _placed(alphabet, window, bits, listed))), no, kind))
    return docs.select("doc_id", F.sort_array(F.concat(*parts)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
