"""Statements that make a thing anew from its catalog row: tables, types, collations, aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import qualified, quote_ident, quote_literal
from .statements import collation_name


def _options(*options: Column) -> Column:
    """Options that are not null, in brackets."""
    return F.concat(F.lit(" ("), F.concat_ws(", ", *options), F.lit(")"))


def _named(word: str, value: Column, given: Column | None = None) -> Column:
    return F.when(given if given is not None else value.isNotNull(), F.concat(F.lit(f"{word} = "), value))


def collation(schema: Column, name: Column, provider: Column, locale: Column, collate: Column, ctype: Column, deterministic: Column) -> Column:
    """Other providers than libc have one locale; libc has one or two."""
    own = provider.isin("i", "b")
    one = collate.eqNullSafe(ctype)
    options = _options(
        _named("PROVIDER", F.when(provider == "i", "icu").when(provider == "b", "builtin").otherwise("libc")),
        _named("LOCALE", quote_literal(F.when(own, F.coalesce(locale, F.lit(""))).otherwise(collate)), own | one),
        _named("LC_COLLATE", quote_literal(collate), ~own & ~one),
        _named("LC_CTYPE", quote_literal(ctype), ~own & ~one),
        F.when(~deterministic, F.lit("DETERMINISTIC = false")),
    )
    return F.concat(F.lit("CREATE COLLATION IF NOT EXISTS "), qualified(schema, name), options)


def composite_type(schema: Column, name: Column, attributes: Column) -> Column:
    parts = F.transform(attributes, lambda a: F.concat_ws(" ", quote_ident(a["name"]), a["type"]))
    return F.concat(F.lit("CREATE TYPE "), qualified(schema, name), F.lit(" AS ("), F.array_join(parts, ", "), F.lit(")"))


def range_type(schema: Column, name: Column, subtype: Column, collation: tuple[Column, Column], canonical: tuple[Column, Column], diff: tuple[Column, Column]) -> Column:
    """collation, canonical, diff: schema and name; null names are left out."""
    options = _options(
        _named("SUBTYPE", subtype), _named("COLLATION", collation_name(*collation), collation[1].isNotNull()),
        _named("CANONICAL", qualified(*canonical), canonical[1].isNotNull()), _named("SUBTYPE_DIFF", qualified(*diff), diff[1].isNotNull()),
    )
    return F.concat(F.lit("CREATE TYPE "), qualified(schema, name), F.lit(" AS RANGE"), options)


def aggregate() -> Column:
    """CREATE AGGREGATE of a row of `relations.aggregates`."""
    c = F.col

    def support(word: str, prefix: str) -> Column:
        return _named(word, qualified(c(f"{prefix}_schema"), c(f"{prefix}_name")), c(f"{prefix}_name").isNotNull())

    def final(word: str, prefix: str, extra: str, modify: str, also: Column) -> list[Column]:
        has = c(f"{prefix}_name").isNotNull() & also
        how = F.when(c(modify) == "s", "SHAREABLE").when(c(modify) == "w", "READ_WRITE").otherwise("READ_ONLY")
        return [F.when(also, support(word, prefix)), F.when(has & c(extra), F.lit(f"{word}_EXTRA")), _named(f"{word}_MODIFY", how, has)]

    moving = c("mtransfn_name").isNotNull()
    options = F.concat_ws(
        ",\n  ",
        support("SFUNC", "transfn"), _named("STYPE", c("transtype")),
        *final("FINALFUNC", "finalfn", "aggfinalextra", "finalmodify", F.lit(True)),
        support("COMBINEFUNC", "combinefn"), support("SERIALFUNC", "serialfn"), support("DESERIALFUNC", "deserialfn"),
        _named("INITCOND", quote_literal(c("agginitval"))),
        support("MSFUNC", "mtransfn"), F.when(moving, support("MINVFUNC", "minvtransfn")), _named("MSTYPE", c("mtranstype"), moving),
        *final("MFINALFUNC", "mfinalfn", "aggmfinalextra", "mfinalmodify", moving),
        _named("MINITCOND", quote_literal(c("aggminitval")), moving & c("aggminitval").isNotNull()),
        F.when(c("parallel") == "s", F.lit("PARALLEL = SAFE")).when(c("parallel") == "r", F.lit("PARALLEL = RESTRICTED")),
    )
    return F.concat(F.lit("CREATE AGGREGATE "), qualified(c("schema_name"), c("agg_name")), F.lit("("), c("args"), F.lit(") (\n  "), options, F.lit("\n)"))


def table(schema: Column, name: Column, definitions: Column) -> Column:
    """CREATE TABLE of columns' definitions (in order), or PARTITION OF for a partition, by `relations.partition_info`."""
    head = F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), qualified(schema, name))
    by = F.coalesce(F.concat(F.lit(" PARTITION BY "), F.col("partition_by")), F.lit(""))
    of = F.concat(head, F.lit(" PARTITION OF "), qualified(F.col("parent_schema"), F.col("parent_name")), F.lit(" "), F.col("bound"), by)
    plain = F.concat(head, F.lit(" (\n  "), F.array_join(definitions, ",\n  "), F.lit("\n)"), by)
    return F.when(F.col("is_partition") & F.col("parent_name").isNotNull(), of).otherwise(plain)


def add_constraint(schema: Column, name: Column, constraint: Column, definition: Column) -> Column:
    return F.concat(F.lit("ALTER TABLE "), qualified(schema, name), F.lit(" ADD CONSTRAINT "), quote_ident(constraint), F.lit(" "), definition)


def view(schema: Column, name: Column, kind: Column, definition: Column, exists: bool = False) -> Column:
    """CREATE of a view; a materialized view that `exists` is dropped first, since it can't be replaced."""
    drop = F.concat(F.lit("DROP MATERIALIZED VIEW IF EXISTS "), qualified(schema, name), F.lit("; ")) if exists else F.lit("")
    materialized = F.concat(drop, F.lit("CREATE MATERIALIZED VIEW "), qualified(schema, name), F.lit(" AS "), definition)
    return F.when(kind == "m", materialized).otherwise(F.concat(F.lit("CREATE OR REPLACE VIEW "), qualified(schema, name), F.lit(" AS "), definition))
