"""Dependency manifests as text -> required packages, for whole collections of manifests.

A requirement is exact or a range. Exact ones are pins and have a ``version``; all others have their
text in ``version_range`` and no version, since which version they resolve to is not in the manifest.
What a package leaves to others to install (``peerDependencies``) is a range, exact or not. A name without any
requirement asks for no version and gives no row.

A manifest that can't be read gives no rows and ends no job: ``broken_manifests`` lists it with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed patterns: one package per line, (package, requirement), by manifest file.
REQUIREMENT = r"^\s*([A-Za-z0-9][\w.\-]*)\s*(?:\[[^\]]*\])?\s*((?:===?|~=|!=|<=?|>=?)[^;#]*)"
GO_LINE = r"^\s*(?:require\s+)?([\w.\-~/]+)\s+(v\d[\w.\-+]*)"
GEM_LINE = r"^ {4}([\w.\-]+) \((\d[\w.\-]*)\)"
CARGO_LINE = r'^\s*"?([\w\-]+)"?\s*=\s*(?:\{[^}]*?\bversion\s*=\s*)?"([^"]+)"'
# Fixed patterns: parts of a go.mod that take versions out or replace them, and the tables of a
# Cargo.toml that hold dependencies, all in one or one each.
GO_OTHER = r"(?m)^\s*(?:exclude|replace|retract)\s*(?:\((?s:.*?)\)|[^\n]*)"
CARGO_TABLE = r"(?:^|\.)(?:dev-|build-)?dependencies$"
CARGO_SINGLE = r"(?:^|\.)(?:dev-|build-)?dependencies\.\"?([\w\-]+)\"?$"
# Parts of a package.json that name dependencies.
JSON_PINS, JSON_PEERS = ("dependencies", "devDependencies", "optionalDependencies"), "peerDependencies"
# Fixed patterns and values: parts of a pom.xml that are no dependencies of its own, a dependency, and
# characters written as entities.
XML_ASIDE = r"(?s)<!--.*?-->|<exclusions>.*?</exclusions>"
XML_DEPENDENCY = r"(?s)<dependency>(.*?)</dependency>"
XML_CHARACTERS = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
# Fixed patterns: exact requirements; the group is the version.
EXACT = {
    "requirements.txt": r"^===?\s*([^\s,*]+)$",
    "package.json": r"^[=v\s]*(\d+\.\d+\.\d+(?:[\-+][0-9A-Za-z.\-+]+)?)$",
    "go.mod": r"^v(.+)$",
    "Gemfile.lock": r"^(.+)$",
    "Cargo.toml": r"^=\s*(\d[\w.\-+]*)$",
    "pom.xml": r"^\[?([\w.\-]*\d[\w.\-]*)\]?$",
}


def _found(package: Column, requirement: Column, peer: bool = False) -> Column:
    return F.struct(package.alias("package"), F.trim(requirement).alias("requirement"), F.lit(peer).alias("peer"))


def _by_line(content: Column, pattern: str) -> Column:
    take = lambda line: _found(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2))
    return F.transform(F.split(content, r"\r?\n"), take)


def _cargo(content: Column) -> Column:
    def of(table: Column) -> Column:
        name = F.regexp_extract(table, r"^\s*\[+([^\]]*)\]", 1)
        single = F.array(_found(F.regexp_extract(name, CARGO_SINGLE, 1), F.regexp_extract(table, r'(?m)^\s*version\s*=\s*"([^"]+)"', 1)))
        none = F.slice(single, F.lit(1), F.lit(0))
        return F.when(name.rlike(CARGO_TABLE), _by_line(table, CARGO_LINE)).when(name.rlike(CARGO_SINGLE), single).otherwise(none)

    return F.flatten(F.transform(F.split(content, r"(?m)^(?=\s*\[)"), of))


def _json(content: Column) -> Column:
    parsed = F.from_json(content, ", ".join(f"{part} MAP<STRING, STRING>" for part in (*JSON_PINS, JSON_PEERS)))
    empty = F.create_map().cast("map<string,string>")
    entries = lambda part: F.map_entries(F.coalesce(parsed[part], empty))
    pins = F.transform(F.concat(*[entries(part) for part in JSON_PINS]), lambda e: _found(e["key"], e["value"]))
    return F.concat(pins, F.transform(entries(JSON_PEERS), lambda e: _found(e["key"], e["value"], peer=True)))


def _xml(content: Column) -> Column:
    """The dependencies of a project file, taken as text: a file that is no XML has parts that look like
    dependencies, or none, and neither ends the job."""
    plain = F.regexp_replace(content, XML_ASIDE, "")

    def text(block: Column, tag: str) -> Column:
        found = F.trim(F.regexp_extract(block, rf"(?s)<{tag}>([^<]*)</{tag}>", 1))
        for name, character in XML_CHARACTERS.items():
            found = F.replace(found, F.lit(f"&{name};"), F.lit(character))
        return found

    def dependency(block: Column) -> Column:
        group, artifact = text(block, "groupId"), text(block, "artifactId")
        return _found(F.when((group != "") & (artifact != ""), F.concat_ws(":", group, artifact)).otherwise(""), text(block, "version"))

    return F.transform(F.regexp_extract_all(plain, F.lit(XML_DEPENDENCY), F.lit(1)), dependency)


def _unreadable(file: Column, content: Column) -> Column:
    """Why a manifest can't be read; null where it can."""
    xml = F.from_xml(content, "_bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    json = F.from_json(content, "_bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    broken = lambda parsed: parsed.isNull() | parsed["_bad"].isNotNull()
    return (
        F.when(~file.isin(*EXACT), "unknown kind")
        .when(content.isNull(), "no content")
        .when((file == "pom.xml") & broken(xml), "not xml")
        .when((file == "package.json") & broken(json), "not json")
    )


def broken_manifests(manifests: DataFrame) -> DataFrame:
    """The manifests that give no rows because they can't be read, with the reason."""
    found = manifests.withColumn("reason", _unreadable(F.col("manifest_file"), F.col("content")))
    return found.filter("reason IS NOT NULL").select("service_id", "ecosystem", "manifest_file", "reason")


def requirements(manifests: DataFrame) -> DataFrame:
    """(service_id, ecosystem, manifest_file, content) -> one row per required package with ``version`` or
    ``version_range``."""
    file, content = F.col("manifest_file"), F.col("content")
    readers = {
        "package.json": _json(content),
        "pom.xml": _xml(content),
        "Cargo.toml": _cargo(content),
        "go.mod": _by_line(F.regexp_replace(content, GO_OTHER, ""), GO_LINE),
        "requirements.txt": _by_line(content, REQUIREMENT),
        "Gemfile.lock": _by_line(content, GEM_LINE),
    }
    found, exact = F.lit(None), F.lit(None)
    for name, reader in readers.items():
        found = F.when(file == name, reader).otherwise(found)
        exact = F.when(file == name, F.regexp_extract("p.requirement", EXACT[name], 1)).otherwise(exact)
    found = F.when(_unreadable(file, content).isNull(), found)
    rows = manifests.select("service_id", "ecosystem", "manifest_file", F.explode(found).alias("p"))
    rows = rows.filter("p.package <> '' AND p.requirement <> ''").withColumn("exact", F.when(~F.col("p.peer"), F.nullif(exact, F.lit(""))))
    return rows.select(
        "service_id", "ecosystem", "manifest_file", "p.package", F.col("exact").alias("version"),
        F.when(F.col("exact").isNull(), F.col("p.requirement")).alias("version_range"),
    )


def manifest_pins(manifests: DataFrame) -> DataFrame:
    """The exact requirements alone."""
    return requirements(manifests).filter("version IS NOT NULL").drop("version_range")
