"""Version ordering as sortable text, and specifier sets evaluated over it.

A version becomes a short string whose byte order is the order of the public version scheme, so
Spark compares, joins and sorts versions without Python. Its parts, in order:

    epoch, release (trailing zeros cut) "!", pre-release rank, pre-release number, post, dev

A number is written with a letter for its length in front ("b7", "c12"), which makes longer numbers
sort after shorter ones whatever their size. "!" sorts before any letter, so ``1.2`` precedes
``1.2.1``. An absent part takes the character that sorts it where the scheme wants it: a plain
``dev`` before any pre-release, a final release after them, no ``post`` ("-") before ``post0``, no
``dev`` ("~") after every ``devN``.

A position is such a key with a side appended: "0" just before the version, "1" on it, "2" just
after it. Every clause of a specifier set is an interval between two positions, so a whole set folds
into one lower and one upper position, plus the few intervals that ``!=`` takes out.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed pattern: the public version scheme (epoch, release, pre, post, dev, local).
_VERSION = (
    r"(?i)^v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|beta|preview|pre|a|b|c|rc)[-_.]?(\d*))?"
    r"(-\d+|[-_.]?(?:post|rev|r)[-_.]?\d*)?"
    r"([-_.]?dev[-_.]?\d*)?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
# Fixed pattern: one clause of a specifier set, white space already removed.
_CLAUSE = r"^(===|~=|==|!=|<=|>=|<|>|=)(.+?)(\.\*)?$"

_PRE_RANK = "map('a', '1', 'alpha', '1', 'b', '2', 'beta', '2', 'c', '3', 'rc', '3', 'pre', '3', 'preview', '3')"
_DEV_ONLY, _FINAL = "0", "4"
_NONE_LOW, _NONE_HIGH = "-", "~"
_ZERO = "b0"
_BEFORE, _ON, _AFTER = "0", "1", "2"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; plain reuse would repeat the expression."""
    return F.transform(F.array(value), body)[0]


def _number(digits: Column) -> Column:
    """Digits with a length letter in front; nothing counts as zero."""
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    letter = F.char(F.length(bare) + ord("a"))
    return F.when(digits == "", F.lit(_ZERO)).otherwise(F.concat(letter, bare))


def _release(parts: Column) -> Column:
    """Release numbers as text, trailing zeros cut, so that ``1.0`` equals ``1.0.0``."""
    return F.regexp_replace(F.array_join(F.transform(parts, _number), ""), f"({_ZERO})+$", "")


def _key(epoch: Column, release: Column, pre: Column, pre_n: Column, post: Column, dev: Column) -> Column:
    return F.concat(epoch, release, F.lit("!"), pre, pre_n, post, dev)


def version_parts(version: Column) -> Column:
    """Parsed version as a struct, NULL when the text is not a version.

    ``key`` sorts; the other fields are what clauses are built from.
    """
    text = F.trim(version)
    # One pass of the pattern: every group of the match, joined by a character no version holds.
    joined = F.regexp_replace(text, _VERSION, "$1|$2|$3|$4|$5|$6|$7")
    groups = F.split(F.lower(joined), r"\|", -1)
    parsed = _let(_let(groups, _fields), _assemble)
    return F.when(F.coalesce(text.rlike(_VERSION), F.lit(False)), parsed)


def _fields(groups: Column) -> Column:
    epoch, release, pre, pre_n, post, dev, local = (groups[i] for i in range(7))
    trailing = lambda text: _number(F.regexp_extract(text, r"(\d*)$", 1))
    without_pre = F.when((post == "") & (dev != ""), _DEV_ONLY).otherwise(_FINAL)
    raw = F.split(release, r"\.")
    return F.struct(
        _number(epoch).alias("epoch"),
        raw.alias("raw"),
        _release(raw).alias("release"),
        F.coalesce(F.try_element_at(F.expr(_PRE_RANK), pre), without_pre).alias("pre"),
        F.when(pre == "", _ZERO).otherwise(_number(pre_n)).alias("pre_n"),
        F.when(post == "", _NONE_LOW).otherwise(trailing(post)).alias("post"),
        F.when(dev == "", _NONE_HIGH).otherwise(trailing(dev)).alias("dev"),
        F.regexp_replace(local, "[-_]", ".").alias("local"),
    )


def _assemble(f: Column) -> Column:
    names = ("epoch", "release", "pre", "pre_n", "post", "dev")
    return F.struct(
        _key(*[f[n] for n in names]).alias("key"), *[f[n].alias(n) for n in (*names, "raw", "local")]
    )


def version_key(version: Column) -> Column:
    """The sortable text alone."""
    return version_parts(version)["key"]


def located(version: Column) -> Column:
    """Struct (position, local) to test against specifiers, NULL when the text is not a version.
    A bare release number, the usual case, skips the full pattern."""
    text = F.trim(version)
    plain = F.concat(F.lit(_ZERO), _release(F.split(text, r"\.")), F.lit(f"!{_FINAL}{_ZERO}{_NONE_LOW}{_NONE_HIGH}{_ON}"))
    parsed = _let(
        version_parts(version),
        lambda v: F.struct(_position(v["key"], _ON).alias("position"), v["local"].alias("local")),
    )
    return F.when(
        text.rlike(r"^\d+(\.\d+)*$"), F.struct(plain.alias("position"), F.lit("").alias("local"))
    ).when(F.coalesce(text.rlike(_VERSION), F.lit(False)), parsed)


def within_bounds(position: Column, low: Column, high: Column) -> Column:
    return position.isNotNull() & (low.isNull() | (low < position)) & (high.isNull() | (position < high))


def _position(key: Column, side: str) -> Column:
    return F.concat(key, F.lit(side))


def _first_of(epoch: Column, release: Column) -> Column:
    """Position before every version of a release, its dev releases included."""
    zero, none = F.lit(_ZERO), F.lit(_NONE_LOW)
    return _position(_key(epoch, release, F.lit(_DEV_ONLY), zero, none, zero), _BEFORE)


def _after_prefix(epoch: Column, raw: Column) -> Column:
    """Position after every version whose release starts with ``raw``."""
    last = (F.element_at(raw, -1).cast("decimal(38,0)") + F.lit(1)).cast("decimal(38,0)").cast("string")
    return _first_of(epoch, _release(F.concat(F.slice(raw, F.lit(1), F.size(raw) - 1), F.array(last))))


def _interval(op: Column, v: Column, wildcard: Column) -> Column:
    """Clause -> struct(low, high) of positions; a NULL end is unbounded."""
    key, epoch, release = v["key"], v["epoch"], v["release"]
    is_pre = (v["pre"] != _FINAL) | (v["dev"] != _NONE_HIGH)
    has_post, has_dev = v["post"] != _NONE_LOW, v["dev"] != _NONE_HIGH
    # "> V" also leaves out the post releases of V, "< V" the pre-releases of V.
    top = F.when(has_post | has_dev, v["post"]).otherwise(F.lit(_NONE_HIGH))
    beyond = _key(epoch, release, v["pre"], v["pre_n"], top, v["dev"])
    own_dev = _key(epoch, release, v["pre"], v["pre_n"], v["post"], F.lit(_ZERO))
    own_first = F.when(has_post, _position(own_dev, _BEFORE)).otherwise(_first_of(epoch, release))
    parent = F.slice(v["raw"], F.lit(1), F.greatest(F.size(v["raw"]) - 1, F.lit(1)))
    low = (
        F.when(op == ">", _position(beyond, _AFTER))
        .when(op.isin("==", "!=") & wildcard, _first_of(epoch, release))
        .when(op.isin(">=", "==", "!=", "~="), _position(key, _BEFORE))
    )
    high = (
        F.when((op == "<") & ~is_pre, own_first)
        .when(op == "<", _position(key, _BEFORE))
        .when(op.isin("==", "!=") & wildcard, _after_prefix(epoch, v["raw"]))
        .when(op.isin("<=", "==", "!="), _position(key, _AFTER))
        .when(op == "~=", _after_prefix(epoch, parent))
    )
    return F.struct(low.alias("low"), high.alias("high"))


def specifier(text: Column) -> Column:
    """Parsed specifier set as a struct, NULL when it is empty or any clause is invalid.

    ``low`` and ``high`` are the tightest bounds of all clauses. ``special`` tells whether there is
    more to test: ``holes``, the intervals taken out, or the rare clauses on a local label
    (``locals``) or on the exact text (``literals``).
    """
    compact = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    items = F.filter(F.split(compact, ","), lambda s: s != "")

    def parse(item: Column) -> Column:
        op = F.regexp_extract(item, _CLAUSE, 1)
        raw = F.regexp_extract(item, _CLAUSE, 2)
        return F.struct(
            F.when(op == "=", F.lit("==")).otherwise(op).alias("op"),
            (F.regexp_extract(item, _CLAUSE, 3) != "").alias("wildcard"),
            raw.alias("raw"),
            version_parts(raw).alias("v"),
        )

    def resolve(c: Column) -> Column:
        return F.struct(
            c["op"].alias("op"),
            c["raw"].alias("raw"),
            c["v"]["local"].alias("local"),
            _interval(c["op"], c["v"], c["wildcard"]).alias("cut"),
            _acceptable(c).alias("acceptable"),
        )

    return _let(F.transform(F.transform(items, parse), resolve), _fold_clauses)


def _acceptable(c: Column) -> Column:
    allowed_wildcard = ~c["wildcard"] | c["op"].isin("==", "!=")
    compatible = (c["op"] != "~=") | (F.size(c["v"]["raw"]) >= 2)
    no_local = (c["v"]["local"] == "") | (c["op"].isin("==", "!=") & ~c["wildcard"])
    well_formed = c["v"].isNotNull() & allowed_wildcard & compatible & no_local
    return F.coalesce((c["op"] == "===") | ((c["op"] != "") & well_formed), F.lit(False))


def _fold_clauses(clauses: Column) -> Column:
    bounds = F.filter(clauses, lambda c: ~c["op"].isin("!=", "==="))
    holes = F.filter(clauses, lambda c: c["op"] == "!=")
    literals = F.filter(clauses, lambda c: c["op"] == "===")
    with_local = F.filter(clauses, lambda c: (c["op"] == "==") & (c["local"] != ""))
    folded = F.struct(
        F.array_max(F.transform(bounds, lambda c: c["cut"]["low"])).alias("low"),
        F.array_min(F.transform(bounds, lambda c: c["cut"]["high"])).alias("high"),
        F.exists(clauses, lambda c: c["op"].isin("!=", "===") | ((c["op"] == "==") & (c["local"] != ""))).alias("special"),
        F.transform(holes, lambda c: F.struct(c["cut"].alias("cut"), c["local"].alias("local"))).alias("holes"),
        F.transform(with_local, lambda c: c["local"]).alias("locals"),
        F.transform(literals, lambda c: F.lower(c["raw"])).alias("literals"),
    )
    return F.when((F.size(clauses) > 0) & F.forall(clauses, lambda c: c["acceptable"]), folded)


def in_range(here: Column, spec: Column, raw_version: Column) -> Column:
    """Does a ``located`` version satisfy a parsed specifier set? False for anything unparseable."""
    position, local = here["position"], here["local"]
    text = F.lower(F.trim(raw_version))

    def outside(hole: Column) -> Column:
        inside = (hole["cut"]["low"] < position) & (position < hole["cut"]["high"])
        return ~(inside & ((hole["local"] == "") | (hole["local"] == local)))

    rest = (
        F.forall(spec["holes"], outside)
        & F.forall(spec["locals"], lambda label: label == local)
        & F.forall(spec["literals"], lambda literal: literal == text)
    )
    answer = within_bounds(position, spec["low"], spec["high"]) & (~spec["special"] | rest)
    return F.coalesce(spec.isNotNull() & answer, F.lit(False))


def is_affected(version: Column, affected_versions: Column, version_range: Column) -> Column:
    """Explicit list first, then the range; an empty list and an empty range affect nothing."""
    listed = F.coalesce(F.array_contains(affected_versions, version), F.lit(False))
    operands = F.struct(located(version).alias("here"), specifier(version_range).alias("spec"))
    return listed | _let(operands, lambda o: in_range(o["here"], o["spec"], version))
