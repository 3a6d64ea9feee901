"""Secret scans with multipart credential linking, in Spark SQL expressions only.

Base spans, leftmost and non-overlapping for each kind: ``assign`` (a keyword, a sign
and a value of 6 or more characters), ``access`` (AKIA and 16 or more characters) and
``hex`` (24 or more hex digits). Weak parts are none of these alone: ``ident``
(a user or client name assigned), ``key`` (20 or more token characters, of any length, with a
letter and a digit, so UUIDs and keys of one case are in) and ``endpoint`` (a URL or a cloud
host). A part's scope is its span widened by SCOPE characters, and scopes that overlap join.
A weak key is reported when an identifier (ident or access) or an endpoint is in scope; a
weak ident when a secret (assign, hex or key) is; an endpoint when an identifier and a secret
both are. Weak parts that overlap a base span, and keys that overlap an endpoint or an ident
(they are part of it), are no candidates.

Spans are found from the text between matches and the matches themselves, in code
points. Nothing is shuffled: the interval join runs over the parts of one row, sorted by start
and swept twice, forward for what begins before a part and backward for what begins after
it, so its cost follows the number of parts.

Defined cases: a null text is empty and has no span; equal starts are ordered by kind;
repeated rows are scanned each; texts of any length are scanned whole, and spans of any
length are reported and masked whole; other columns pass through ``redact`` and are ignored
elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = 200
#: Base kinds in the order of their listing, then the linked ones.
KINDS = ("assign", "access", "hex", "link_ident", "link_key", "link_endpoint")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (pattern of the matches, quick test whether there can be any)
PATTERNS = {
    "assign": (ASSIGN, r"(?i)password|passwd|secret|token|api_?key"),
    "access": (r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
    "ident": (r"""(?i)(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{4,}""", r"(?i)user|login|client_?id|account|access_?key"),
    "key": (r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+/_=-]{20}"),
    "endpoint": (r"https?://[A-Za-z0-9.:_~/?#@!$&*+,;=%-]+|[A-Za-z0-9.-]+\.(?:amazonaws|azure|googleapis)\.com", r"https?://|\.(?:amazonaws|azure|googleapis)\.com"),
}
PART = "struct<start:int,kind_no:int,stop:int,part:string>"
#: Numbers of the kinds in PART: the base kinds as listed, then ident, key and endpoint.
IDENT, KEY, ENDPOINT = 3, 4, 5
#: Elements of a run in sweep_sql, and characters of a piece in redact.
CHUNK = 64
PIECE = 1024


def quoted(pattern: str) -> str:
    """A raw SQL string of the pattern; what it quotes must not end it."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sweep_sql(rows: str, kind: str, state: dict[str, tuple[str, str, str]], out: str, when: str = "true") -> str:
    """Array of ``out`` (of type ``kind``) for each element s of ``rows`` where ``when`` holds, with a running state a.

    ``state`` has each field's start, the value that an element gives, and the function (+, greatest or least) that joins
    it to what came before. Spark copies the state of aggregate() at each element, so it must stay small: the elements
    are swept in runs of CHUNK, and each run begins with what the runs before it give.
    """
    def joined_to(how: str, a: str, b: str) -> str:
        return f"{a} + {b}" if how == "+" else f"{how}({a}, {b})"

    start = ", ".join(f"'{k}', {v[0]}" for k, v in state.items())
    step = ", ".join(f"'{k}', {joined_to(v[2], 'a.' + k, v[1])}" for k, v in state.items())
    total = ", ".join(f"'{k}', {joined_to(v[2], 'a.' + k, 's.' + k)}" for k, v in state.items())
    first = ", ".join(f"'{k}', b.{k}" for k in state)
    runs = f"transform(sequence(0, greatest(0, cast((size(r) - 1) div {CHUNK} as int))), c -> slice(r, c * {CHUNK} + 1, {CHUNK}))"
    sums = f"transform(x, y -> aggregate(y, named_struct({start}), (a, s) -> named_struct({step})))"
    run = f"""aggregate(y, named_struct({first}, 'out', cast(array() as array<{kind}>)),
        (a, s) -> named_struct({step}, 'out', case when {when} then concat(a.`out`, array({out})) else a.`out` end), a -> a.`out`)"""
    begun = let("b", f"aggregate(slice(t, 1, c), named_struct({start}), (a, s) -> named_struct({total}))", run)
    return let("r", rows, let("x", runs, let("t", sums, f"flatten(transform(x, (y, c) -> {begun}))")))


def spans_sql(text: str, kind: str, number: int) -> str:
    """Array of (start, kind_no, stop, part) of the kind's matches in ``text``."""
    pattern, quick = (quoted(p) for p in PATTERNS[kind])
    gap, part = "length(s['0'])", "s['1']"
    found = sweep_sql(
        f"arrays_zip(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0))", PART,
        {"at": ("0", f"{gap} + coalesce(length({part}), 0)", "+")},
        f"named_struct('start', a.at + {gap}, 'kind_no', {number}, 'stop', a.at + {gap} + length({part}), 'part', {part})", f"{part} is not null")
    return f"case when {text} rlike {quick} then {found} else cast(array() as array<{PART}>) end"


def flagged(rows: str, backward: bool, groups: dict[str, str], widen: int) -> str:
    """Each element with ``near_<group>``: whether an element of the group (a condition on s) that came before it in this direction overlaps it, widened.

    Forward, the farthest stop of the group so far decides; backward, the nearest start.
    """
    flags = "".join(f", 'near_{g}', {'s.near_' + g + ' or ' if backward else ''}{f'a.{g} < s.stop + {widen}' if backward else f'a.{g} > s.start - {widen}'}" for g in groups)
    kind = PART[:-1] + "".join(f",near_{g}:boolean" for g in groups) + ">"
    none = f"{1 << 30}" if backward else f"{-(1 << 30)}"
    state = {g: (none, f"case when {when} then {'s.start' if backward else 's.stop'} else {none} end", "least" if backward else "greatest") for g, when in groups.items()}
    return sweep_sql(rows, kind, state, f"named_struct('start', s.start, 'kind_no', s.kind_no, 'stop', s.stop, 'part', s.part{flags})")


def swept(rows: str, groups: dict[str, str], widen: int) -> str:
    """The sorted elements, backwards, with the flags of both directions."""
    return flagged(f"reverse({flagged(rows, False, groups, widen)})", True, groups, widen)


def scanned(docs: DataFrame, scope: int = SCOPE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, __text, and ``spans``: array of (start, kind_no, stop, kind, part) in order."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("__text"))
    names = [f"`{c}`" for c in keep]
    value = quoted(ASSIGN)
    token = "s.part rlike '[A-Za-z]' and s.part rlike '[0-9]'"
    found = {k: spans_sql("__text", k, n) for n, k in enumerate(PATTERNS)}
    found["assign"] = f"filter({found['assign']}, s -> length(regexp_extract(s.part, {value}, 2)) >= 6)"
    found["key"] = f"filter({found['key']}, s -> {token})"
    every = rows.selectExpr(*names, "__text", f"sort_array(concat({', '.join(found.values())})) as __parts")
    inner = swept("__parts", {"base": "s.kind_no < 3", "whole": f"s.kind_no in ({IDENT}, {ENDPOINT})"}, 0)
    free = every.selectExpr(*names, "__text", f"reverse(filter({inner}, s -> s.kind_no < 3 or not (s.near_base or s.kind_no = {KEY} and s.near_whole))) as __parts")
    groups = {"name": f"s.kind_no in (1, {IDENT})", "secret": f"s.kind_no in (0, 2, {KEY})", "place": f"s.kind_no = {ENDPOINT}"}
    outer = swept("__parts", groups, 2 * scope)  # scopes of both sides widen
    chosen = f"""s.kind_no < 3 or s.kind_no = {IDENT} and s.near_secret or s.kind_no = {KEY} and (s.near_name or s.near_place)
        or s.kind_no = {ENDPOINT} and s.near_name and s.near_secret"""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return free.selectExpr(*names, "__text", f"""transform(reverse(filter({outer}, s -> {chosen})),
        s -> named_struct('start', s.start, 'kind_no', s.kind_no, 'stop', s.stop, 'kind', {kinds}[s.kind_no], 'part', s.part)) as spans""")


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.stop as string))), ',')"


def summary(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text), n_linked."""
    count = lambda k: f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) as n_{k}"
    return scanned(docs, scope).selectExpr(
        "doc_id", count("assign"), count("access"), count("hex"), f"sha2({joined('filter(spans, s -> s.kind_no < 3)')}, 256) as base_sha256",
        f"{joined('spans')} as spans", "cast(size(filter(spans, s -> s.kind_no >= 3)) as bigint) as n_linked")


def redact(docs: DataFrame, mask: str = "[REDACTED]", scope: int = SCOPE) -> DataFrame:
    """The documents with every reported span replaced by the mask (overlapping ones by one); n_chars follows if there."""
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    own, place = plain.columns, docs.columns.index("text")
    found = scanned(plain.withColumn("text", F.col(f"_{place}")), scope, keep=tuple(own))
    # what is kept is cut from pieces of the text, as a place in it is found by counting from the beginning
    gaps = sweep_sql("spans", "struct<low:int,high:int>", {"at": ("0", "s.stop", "greatest")}, "named_struct('low', a.at, 'high', s.start)", "s.start >= a.at")

    def cut(low: str, high: str) -> str:
        return f"substring(array_join(slice(p, {low} div {PIECE} + 1, {high} div {PIECE} - {low} div {PIECE} + 1), ''), {low} % {PIECE} + 1, {high} - {low})"

    last = let("e", "array_max(transform(spans, s -> s.stop))", cut("cast(e as int)", "length(__text)"))
    pieces = let("p", f"regexp_extract_all(__text, '(?s).{{1,{PIECE}}}', 0)", f"concat(array_join(transform({gaps}, g -> concat({cut('g.low', 'g.high')}, {quoted(mask)})), ''), {last})")
    masked = found.selectExpr(*own, f"case when size(spans) = 0 then _{place} else {pieces} end as __masked")
    out = []
    for i, field in enumerate(docs.schema.fields):
        if i == place:
            out.append(F.col("__masked").alias("text"))
        elif field.name == "n_chars":
            out.append(F.when(F.col(f"_{place}").eqNullSafe(F.col("__masked")), F.col(f"_{i}")).otherwise(F.length("__masked")).cast(field.dataType).alias("n_chars"))
        else:
            out.append(F.col(f"_{i}").alias(field.name))
    return masked.select(*out)
