"""Column functions on paths, references, dependency keys and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATEST = "latest"


def classify_source(path: Column, system_dir: str = "system") -> Column:
    return F.when(path.endswith(".spec.md"), "spec").when(path.startswith(f"{system_dir}/"), "system").otherwise("object")


def classify_document(path: Column) -> Column:
    """By the first directory. Fixed values."""
    out = F.when(path.startswith("foundation/"), "foundation")
    for prefix, kind in (("topics/", "topic"), ("plans/", "plan"), ("prompts/", "prompt"), ("system/", "system"), ("packages/", "package")):
        out = out.when(path.startswith(prefix), kind)
    return out.otherwise("topic")


def output_dir(kind: Column) -> Column:
    return F.when(kind == "spec", "specs").when(kind == "system", "system").otherwise("objects")


def id_prefix(kind: Column) -> Column:
    return F.when(kind == "spec", "spec").when(kind == "system", "sys").otherwise("obj")


def format_id(kind: Column, digest: Column, sequence: Column) -> Column:
    return F.concat(id_prefix(kind), F.lit(":"), digest, F.lit("."), sequence.cast("string"))


def join_segments(base: Column, parts: Column, keep_above: bool) -> Column:
    """Folds . and .. of base + parts; .. above the root stays only if keep_above."""

    def step(acc: Column, part: Column) -> Column:
        up = F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        above = F.concat(acc, F.array(F.lit(".."))) if keep_above else acc
        return F.when(part.isin(".", ""), acc).when(part == "..", up.otherwise(above)).otherwise(F.concat(acc, F.array(part)))

    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.concat(base, parts), empty, step), "/")


def resolve_link(source: Column, target: Column, keep_above: bool = False) -> Column:
    """A relative link's path; empty for fragments, addresses and what is empty without its fragment."""
    plain = F.substring_index(target, "#", 1)
    segments = F.split(source, "/")
    base = F.slice(segments, 1, F.size(segments) - 1)
    found = join_segments(base, F.split(plain, "/"), keep_above)
    return F.when(target.contains("://") | (plain == ""), "").otherwise(found)


def parse_ids(raw: Column) -> Column:
    """The ids of a list with commas, without blanks around them and without empty ones."""
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_ref(ref: Column) -> Column:
    """struct(kind, package, path): of name@author/path, name@author, or a local path."""
    after = F.substring(ref, F.locate("@", ref) + 1, F.lit(1 << 30))
    slash = F.locate("/", after)
    name = F.substring_index(ref, "@", 1)
    kind = F.when(~ref.contains("@"), "local").when(slash == 0, "package").otherwise("package_path")
    path = F.when(~ref.contains("@"), ref).when(slash == 0, "").otherwise(F.substring(after, slash + 1, F.lit(1 << 30)))
    return F.struct(kind.alias("kind"), F.when(ref.contains("@"), name).otherwise("").alias("package"), path.alias("path"))


def parse_dep_key(key: Column) -> Column:
    """struct(name, author, version) of name@author:version, else null."""
    pattern = r"(?s)^([^@]+)@([^:]+):(.+)$"
    part = lambda i: F.regexp_extract(key, pattern, i)
    return F.when(key.rlike(pattern), F.struct(part(1).alias("name"), part(2).alias("author"), part(3).alias("version")))


def parse_partial_key(key: Column) -> Column:
    """struct(name, author, version) with empty parts for what is missing; null without a name."""
    key = F.trim(key)
    at, colon = F.locate("@", key), F.locate(":", key)
    rest = lambda i: F.substring(key, i + 1, F.lit(1 << 30))
    full, author, version = (at > 0) & (colon > at), (at > 0) & (colon == 0), (at == 0) & (colon > 0)
    name = F.when(full | author, F.substring_index(key, "@", 1)).when(version, F.substring_index(key, ":", 1)).otherwise(key)
    out = F.struct(
        name.alias("name"),
        F.when(full, F.substring_index(rest(at), ":", 1)).when(author, rest(at)).otherwise("").alias("author"),
        F.when(full | version, rest(colon)).otherwise("").alias("version"),
    )
    return F.when(name != "", out)


def tag_of(version: Column) -> Column:
    return F.when(version.startswith("v"), version).otherwise(F.concat(F.lit("v"), version))


def version_of(tag: Column) -> Column:
    return F.regexp_replace(tag, "^v", "")


def constraint_version(constraint: Column) -> Column:
    return F.regexp_replace(constraint, "^>=", "")


def to_range(version: Column) -> Column:
    return F.when((version == LATEST) | version.rlike("^[><=]"), version).otherwise(F.concat(F.lit(">="), version))


def bump(version: Column, part: str) -> Column:
    """The next version, or null unless it is x.y.z."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)$"
    a, b, c = (F.regexp_extract(version, pattern, i).cast("bigint") for i in (1, 2, 3))
    zero = F.lit(0).cast("bigint")
    parts = {"major": (a + 1, zero, zero), "minor": (a, b + 1, zero), "patch": (a, b, c + 1)}[part]
    return F.when(version.rlike(pattern), F.concat_ws(".", *[p.cast("string") for p in parts]))


SEMVER = (
    r"^v(0|[1-9]\d*)(?:\.(0|[1-9]\d*)(?:\.(0|[1-9]\d*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?)?)?$"
)


def is_semver(tag: Column) -> Column:
    """Also with minor or patch left out; numbers in a pre-release have no leading zeros."""
    return tag.rlike(SEMVER) & ~F.regexp_extract(tag, SEMVER, 4).rlike(r"(^|\.)0[0-9]+(\.|$)")


def semver_key(tag: Column) -> Column:
    """A struct that sorts as versions do: numbers, then release over pre-release, then its identifiers."""
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract(tag, SEMVER, i), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    before = F.regexp_extract(tag, SEMVER, 4)
    # identifiers of digits sort below others, and by value
    rank = lambda p: F.struct((~p.rlike(r"^\d+$")).cast("int").alias("k"), F.when(p.rlike(r"^\d+$"), p.cast("bigint")).otherwise(0).alias("n"), p.alias("t"))
    parts = F.when(before == "", F.array().cast("array<struct<k:int,n:bigint,t:string>>")).otherwise(F.transform(F.split(before, r"\."), rank))
    return F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (before == "").alias("release"), parts.alias("pre"))


def compatible(a: Column, b: Column) -> Column:
    a, b = tag_of(a), tag_of(b)
    return is_semver(a) & is_semver(b) & (F.regexp_extract(a, SEMVER, 1) == F.regexp_extract(b, SEMVER, 1))
