"""Statements rendered from catalog rows, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import qualified, quote_ident, quote_literal

#: Settings whose value is a list and is rendered as it is.
LIST_SETTINGS = ["local_preload_libraries", "search_path", "session_preload_libraries", "shared_preload_libraries", "temp_tablespaces", "unix_socket_directories"]


def grantee_text(grantee: Column) -> Column:
    return F.when(F.coalesce(grantee, F.lit("PUBLIC")) == "PUBLIC", F.lit("PUBLIC")).otherwise(quote_ident(grantee))


def object_text(kind: Column, schema: Column, name: Column, arguments: Column | None = None) -> Column:
    """What GRANT and ALTER … OWNER call an object: views go as TABLE, routines with their arguments,
    schemas and databases by name alone."""
    arguments = F.coalesce(arguments, F.lit("")) if arguments is not None else F.lit("")
    call = F.concat(qualified(schema, name), F.lit("("), arguments, F.lit(")"))
    return (
        F.when(kind.isin("schema", "database"), F.concat_ws(" ", F.upper(kind), quote_ident(name)))
        .when(kind.isin("function", "procedure"), F.concat_ws(" ", F.lit("ROUTINE"), call))
        .when(kind.isin("table", "view", "materialized_view"), F.concat_ws(" ", F.lit("TABLE"), qualified(schema, name)))
        .otherwise(F.concat_ws(" ", F.upper(kind), qualified(schema, name)))
    )


# What default privileges call the kinds of objects.
DEFAULT_KINDS = {"r": "TABLES", "S": "SEQUENCES", "f": "FUNCTIONS", "T": "TYPES", "n": "SCHEMAS"}


def privilege_change(verb: str) -> Column:
    """GRANT or REVOKE of a row of `relations.privileges`; null for a kind of default that can't be stated."""
    c = F.col
    what = object_text(c("kind"), c("schema_name"), c("object_name"), c("func_args"))
    plain = grant(c("privilege_type"), what, c("grantee"), c("is_grantable")) if verb == "GRANT" else revoke(c("privilege_type"), what, c("grantee"))
    kinds = F.lit(None).cast("string")
    for code, word in DEFAULT_KINDS.items():
        kinds = F.when(c("objtype") == code, word).otherwise(kinds)
    inner = grant(c("privilege_type"), kinds, c("grantee"), c("is_grantable")) if verb == "GRANT" else revoke(c("privilege_type"), kinds, c("grantee"))
    scope = F.coalesce(F.concat(F.lit("IN SCHEMA "), quote_ident(c("schema_name")), F.lit(" ")), F.lit(""))
    default = F.concat(F.lit("ALTER DEFAULT PRIVILEGES FOR ROLE "), quote_ident(c("for_role")), F.lit(" "), scope, inner)
    return F.when(c("acl_kind") == "default", default).otherwise(plain)


def grant(privilege: Column, what: Column, grantee: Column, grantable: Column) -> Column:
    option = F.when(grantable, F.lit(" WITH GRANT OPTION")).otherwise(F.lit(""))
    return F.concat(F.lit("GRANT "), privilege, F.lit(" ON "), what, F.lit(" TO "), grantee_text(grantee), option)


def revoke(privilege: Column, what: Column, grantee: Column) -> Column:
    return F.concat(F.lit("REVOKE "), privilege, F.lit(" ON "), what, F.lit(" FROM "), grantee_text(grantee))


def owner_change(what: Column, owner: Column) -> Column:
    return F.concat(F.lit("ALTER "), what, F.lit(" OWNER TO "), quote_ident(owner))


def set_value(sequence: Column, value: Column, called: Column) -> Column:
    """setval of a sequence (its qualified name): `called` tells whether the value was handed out."""
    return F.concat(F.lit("SELECT setval("), quote_literal(sequence), F.lit(", "), value.cast("string"), F.lit(", "), called.cast("string"), F.lit(")"))


def trigger_state(schema: Column, table: Column, trigger: Column, state: Column) -> Column:
    """The statement for a trigger that is not in its usual state (`O`); null if it is."""
    word = F.when(state == "D", "DISABLE TRIGGER").when(state == "R", "ENABLE REPLICA TRIGGER").when(state == "A", "ENABLE ALWAYS TRIGGER")
    return F.when(word.isNotNull(), F.concat(F.lit("ALTER TABLE "), qualified(schema, table), F.lit(" "), word, F.lit(" "), quote_ident(trigger)))


def policy(schema: Column, table: Column, name: Column, command: Column, permissive: Column, roles: Column, using: Column, check: Column) -> Column:
    clause = lambda word, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f" {word} ("), x, F.lit(")"))).otherwise(F.lit(""))
    named = F.when(F.coalesce(F.size(roles), F.lit(0)) > 0, roles).otherwise(F.array(F.lit("PUBLIC")))
    verb = F.when(command == "r", "SELECT").when(command == "a", "INSERT").when(command == "w", "UPDATE").when(command == "d", "DELETE").otherwise("ALL")
    return F.concat(
        F.lit("CREATE POLICY "), quote_ident(name), F.lit(" ON "), qualified(schema, table),
        F.lit(" AS "), F.when(permissive, "PERMISSIVE").otherwise("RESTRICTIVE"), F.lit(" FOR "), verb,
        F.lit(" TO "), F.array_join(F.transform(F.array_sort(named), grantee_text), ", "),
        clause("USING", using), clause("WITH CHECK", check),
    )


def enum_type(schema: Column, name: Column, labels: Column) -> Column:
    return F.concat(F.lit("CREATE TYPE "), qualified(schema, name), F.lit(" AS ENUM ("), F.array_join(F.transform(labels, quote_literal), ", "), F.lit(")"))


def enum_value(schema: Column, name: Column, label: Column) -> Column:
    return F.concat(F.lit("ALTER TYPE "), qualified(schema, name), F.lit(" ADD VALUE IF NOT EXISTS "), quote_literal(label))


def domain(schema: Column, name: Column, base: Column, default: Column, not_null: Column, checks: Column) -> Column:
    return F.concat(
        F.lit("CREATE DOMAIN "), qualified(schema, name), F.lit(" AS "), base,
        F.coalesce(F.concat(F.lit(" DEFAULT "), default), F.lit("")),
        F.when(not_null, " NOT NULL").otherwise(""),
        F.coalesce(F.array_join(F.transform(checks, lambda c: F.concat(F.lit(" "), c)), ""), F.lit("")),
    )


def collation_name(schema: Column, name: Column) -> Column:
    """A collation as statements refer to it: with its schema, unless that is the system's."""
    return F.when(schema.isNotNull() & (schema != "pg_catalog"), qualified(schema, name)).otherwise(quote_ident(name))


def column_definition(c: dict[str, Column]) -> Column:
    """One column of CREATE TABLE: identity, sequence default, generated or plain, the first that holds."""
    head = F.concat_ws(" ", quote_ident(c["column_name"]), c["data_type"])
    collate = F.coalesce(F.concat(F.lit(" COLLATE "), collation_name(c["collation_schema"], c["collation_name"])), F.lit(""))
    not_null = F.when(c["not_null"], " NOT NULL").otherwise("")
    default = F.coalesce(F.concat(F.lit(" DEFAULT "), c["column_default"]), F.lit(""))
    always = F.when(c["identity"] == "a", "ALWAYS").otherwise("BY DEFAULT")
    options = F.coalesce(F.concat(F.lit(" ("), c["identity_options"], F.lit(")")), F.lit(""))
    return (
        F.when(c["identity"].isin("a", "d"), F.concat(head, F.lit(" GENERATED "), always, F.lit(" AS IDENTITY"), options))
        .when(F.coalesce(F.startswith(c["column_default"], F.lit("nextval(")), F.lit(False)), F.concat(head, collate, not_null, default))
        .when(c["is_generated"], F.concat(head, collate, F.lit(" GENERATED ALWAYS AS ("), c["column_default"], F.lit(") STORED")))
        .otherwise(F.concat(head, collate, not_null, default))
    )


def setting(database: Column, entry: Column) -> Column:
    """ALTER DATABASE … SET of a `name=value` entry; list settings keep their value as it is."""
    name = F.split_part(entry, F.lit("="), F.lit(1))
    value = F.substring(entry, F.length(name) + 2, F.length(entry))
    shown = F.when(name.isin(LIST_SETTINGS), value).otherwise(quote_literal(value))
    return F.concat(F.lit("ALTER DATABASE "), quote_ident(database), F.lit(" SET "), quote_ident(name), F.lit(" TO "), shown)


def sequence(c: dict[str, Column]) -> Column:
    """CREATE SEQUENCE with all that is known of it: increment, bounds, start, cache, cycle."""
    part = lambda word, name: F.concat(F.lit(f" {word} "), c[name].cast("string"))
    parts = [part("INCREMENT BY", "increment"), part("MINVALUE", "min"), part("MAXVALUE", "max"), part("START WITH", "start"), part("CACHE", "cache")]
    cycle = F.when(c["cycle"], " CYCLE").when(~c["cycle"], " NO CYCLE")
    made = F.concat(F.lit("CREATE SEQUENCE IF NOT EXISTS "), qualified(c["schema_name"], c["sequence_name"]))
    return F.concat(made, *[F.coalesce(p, F.lit("")) for p in [*parts, cycle]])
