"""Bills of materials from the current dependency state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Package URL type by ecosystem.
PURL_TYPES = {"pypi": "pypi", "npm": "npm", "maven": "maven", "go": "golang", "cargo": "cargo", "rubygems": "gem"}


def package_url() -> Column:
    kind = F.col("ecosystem")
    for ecosystem, name in PURL_TYPES.items():
        kind = F.when(F.col("ecosystem") == ecosystem, F.lit(name)).otherwise(kind)
    path = (
        F.when(F.col("ecosystem") == "maven", F.replace("package", F.lit(":"), F.lit("/")))
        .when(F.col("ecosystem") == "go", F.lower("package"))
        .when(F.col("ecosystem") == "pypi", F.replace(F.lower("package"), F.lit("_"), F.lit("-")))
        .otherwise(F.col("package"))
    )
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.replace(_escaped(path), F.lit("%2F"), F.lit("/")), F.lit("@"), _escaped(F.col("version")))


def _escaped(text: Column) -> Column:
    """Percent-encoded as package URLs are, which leave letters, digits and ``.-_~:`` as they are."""
    found = F.url_encode(text)
    for theirs, ours in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":")):
        found = F.replace(found, F.lit(theirs), F.lit(ours))
    return found


def _documents(pins: DataFrame, entry: Column) -> DataFrame:
    """Entries per service: a bill of materials is one document, whatever its size."""
    return pins.groupBy("service_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def cyclonedx(pins: DataFrame, generated_at: Column) -> DataFrame:
    """CycloneDX 1.5 documents, one per service."""
    component = F.struct(
        F.lit("library").alias("type"), F.col("package").alias("name"), "version", package_url().alias("purl")
    )
    bom = F.struct(
        F.lit("CycloneDX").alias("bomFormat"),
        F.lit("1.5").alias("specVersion"),
        F.lit(1).alias("version"),
        F.struct(
            generated_at.alias("timestamp"),
            F.struct(F.lit("application").alias("type"), F.col("service_id").alias("name")).alias("component"),
        ).alias("metadata"),
        F.col("entries").alias("components"),
    )
    return _documents(pins, component).select(
        "service_id", F.size("entries").alias("components"), F.to_json(bom).alias("document")
    )


def spdx(pins: DataFrame, generated_at: Column) -> DataFrame:
    """SPDX 2.3 documents with the same packages."""
    package = F.struct(
        F.concat(F.lit("SPDXRef-"), F.substring(F.sha2(package_url(), 256), 1, 16)).alias("SPDXID"),
        F.col("package").alias("name"),
        F.col("version").alias("versionInfo"),
        F.lit("NOASSERTION").alias("downloadLocation"),
        F.array(
            F.struct(
                F.lit("PACKAGE-MANAGER").alias("referenceCategory"),
                F.lit("purl").alias("referenceType"),
                package_url().alias("referenceLocator"),
            )
        ).alias("externalRefs"),
    )
    document = F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"),
        F.lit("CC0-1.0").alias("dataLicense"),
        F.lit("SPDXRef-DOCUMENT").alias("SPDXID"),
        F.col("service_id").alias("name"),
        F.concat(F.lit("urn:sbom:"), F.sha2(F.concat_ws("|", "service_id", generated_at.cast("string"), F.to_json("entries")), 256)).alias("documentNamespace"),
        F.struct(generated_at.alias("created"), F.array(F.lit("Tool: pinwatch")).alias("creators")).alias("creationInfo"),
        F.col("entries").alias("packages"),
        F.transform(
            "entries",
            lambda e: F.struct(
                F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"),
                F.lit("DESCRIBES").alias("relationshipType"),
                e["SPDXID"].alias("relatedSpdxElement"),
            ),
        ).alias("relationships"),
    )
    return _documents(pins, package).select(
        "service_id", F.size("entries").alias("packages"), F.to_json(document).alias("document")
    )


def write_sboms(documents: DataFrame, path: str, day: str) -> None:
    """One JSON document per line below ``<path>/day=<day>/``; services are spread over files by
    size, since a directory per service would be as many files as services."""
    documents.withColumn("day", F.lit(day)).write.mode("append").partitionBy("day").json(path)
