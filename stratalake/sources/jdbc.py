"""Table reads from relational databases.

One table becomes one read per key range, so each executor task moves its own
rows from the database to storage and nothing passes through the driver.
"""

from __future__ import annotations

import datetime as dt
import decimal
import logging
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from stratalake.contracts import FETCH_SIZE
from stratalake.sinks.landing import check_identifier

log = logging.getLogger(__name__)

# Defaults of the settings of a copy: rows of one read, and reads of one table. A table
# of more than their product has larger reads.
ROWS_PER_READ = 1_000_000
MAX_READS = 10_000

# Keys sampled per read: the sizes of the reads then differ by a few percent.
SAMPLED_PER_READ = 400
# ``split_by`` for a split by the identity of rows.
ROW = "*"


@dataclass(frozen=True)
class Dialect:
    """How a database spells names and addresses."""

    driver: str
    url: str
    port: int
    quotes: str
    qualified: bool = True
    backslash_escapes: bool = False
    typed_dates: bool = True
    remainder: str = "MOD({value}, {parts})"
    row_hash: str = ""  # an integer that is the same whenever an unchanged row is read
    sample: tuple[str, str] = ("", "")  # behind the table's name, and behind its WHERE
    as_of: str = ""  # a table as it was, for databases that keep former rows

    def quote(self, name: str) -> str:
        return f"{self.quotes[0]}{name}{self.quotes[1]}"

    def table(self, schema: str, table: str) -> str:
        check_identifier(schema, "schema")
        check_identifier(table, "table")
        if not self.qualified:
            return self.quote(table)
        return f"{self.quote(schema)}.{self.quote(table)}"

    def part(self, column: str, parts: int, number: int) -> str:
        """Condition of one of ``parts`` parts by an integer column; NULLs are in the first."""
        value = self.quote(check_identifier(column, "split_by"))
        return self._remains(value, parts, number)

    def part_of_rows(self, columns: Sequence[str], parts: int, number: int) -> str:
        """Condition of one of ``parts`` parts by the identity of rows, or by a hash of their
        ``columns`` where rows have none."""
        names = ", ".join(self.quote(c.replace(self.quotes[1], self.quotes[1] * 2)) for c in columns)
        return self._remains(self.row_hash.format(columns=names), parts, number)

    def _remains(self, value: str, parts: int, number: int) -> str:
        remainder = self.remainder.format(value=f"ABS({value})", parts=parts)
        return f"COALESCE({remainder}, 0) = {number}"

    def literal(self, value: Any) -> str | None:
        """A key value as SQL text; None for a type that has no safe spelling."""
        match value:
            case bool():
                return None
            case int() | float():
                return repr(value)
            case decimal.Decimal():
                return format(value, "f")
            case dt.datetime():
                # as datetime2: the older type refuses more than three decimals
                text = value.isoformat(" " if self.typed_dates else "T")
                return f"TIMESTAMP '{text}'" if self.typed_dates else f"CAST('{text}' AS datetime2)"
            case dt.date():
                text = value.isoformat()
                return f"DATE '{text}'" if self.typed_dates else f"'{text}'"
            case str():
                text = value.replace("'", "''")
                if self.backslash_escapes:
                    text = text.replace("\\", "\\\\")
                return f"'{text}'"
        return None


# JDBC driver classes, address patterns, default ports, name quotes, row
# identities and clauses of the five databases. MySQL reads the schema named in its address.
DIALECTS = {
    "mysql": Dialect(
        "com.mysql.cj.jdbc.Driver",
        "jdbc:mysql://{host}:{port}/{database}",
        3306,
        "``",
        qualified=False,
        backslash_escapes=True,
        row_hash="CRC32(CONCAT_WS('|', {columns}))",
        sample=("", " AND RAND() * 100 < {percent}"),
    ),
    "postgres": Dialect(
        "org.postgresql.Driver",
        "jdbc:postgresql://{host}:{port}/{database}",
        5432,
        '""',
        row_hash="CAST(HASHTEXT(CAST(ctid AS text)) AS bigint)",
        sample=(" TABLESAMPLE BERNOULLI ({percent})", ""),
    ),
    "sqlserver": Dialect(
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
        1433,
        "[]",
        typed_dates=False,
        remainder="{value} % {parts}",
        row_hash="CAST(CHECKSUM(%%physloc%%) AS bigint)",
        sample=("", " AND ABS(CAST(CHECKSUM(NEWID()) AS bigint)) % 1000000 < {percent} * 10000"),
        as_of=" FOR SYSTEM_TIME AS OF {at}",
    ),
    "oracle": Dialect(
        "oracle.jdbc.OracleDriver",
        "jdbc:oracle:thin:@//{host}:{port}/{database}",
        1521,
        '""',
        row_hash="ORA_HASH(ROWID)",
        sample=(" SAMPLE ({percent})", ""),
        as_of=" AS OF TIMESTAMP {at}",
    ),
    "sap_hana": Dialect(
        "com.sap.db.jdbc.Driver",
        "jdbc:sap://{host}:{port}/?databaseName={database}",
        30015,
        '""',
        row_hash='"$rowid$"',
        sample=(" TABLESAMPLE BERNOULLI ({percent})", ""),
        as_of=" FOR SYSTEM_TIME AS OF {at}",
    ),
}


@dataclass(frozen=True)
class Connection:
    """Address and login of a source database."""

    dialect: Dialect
    host: str
    database: str
    user: str
    password: str
    port: int | None = None

    def url(self, schema: str | None = None) -> str:
        """Address; a dialect without qualified names connects to the schema."""
        database = self.database if self.dialect.qualified else (schema or self.database)
        return self.dialect.url.format(
            host=self.host, port=self.port or self.dialect.port, database=database
        )

    def properties(self) -> dict[str, str]:
        return {
            "driver": self.dialect.driver,
            "user": self.user,
            "password": self.password,
            "fetchsize": str(FETCH_SIZE),
        }


def connection(spark: SparkSession, dialect: str, conn_id: str) -> Connection:
    """Connection from the session settings stratalake.connection.<conn_id>.*;
    Spark redacts the password setting in its logs and UI."""

    def setting(name: str, default: str = "") -> str:
        return spark.conf.get(f"stratalake.connection.{conn_id}.{name}", default)

    if not setting("host"):
        raise ValueError(f"stratalake.connection.{conn_id}.host is not set")
    port = setting("port")
    return Connection(
        dialect=DIALECTS[dialect],
        host=setting("host"),
        database=setting("database"),
        user=setting("user"),
        password=setting("password"),
        port=int(port) if port else None,
    )


def count_sql(dialect: Dialect, schema: str, table: str, key: str | None = None) -> str:
    """(rows, rows with a key)"""
    keyed = dialect.quote(check_identifier(key, "primary_key")) if key else "*"
    return f"SELECT COUNT(*) AS n, COUNT({keyed}) AS keyed FROM {dialect.table(schema, table)}"


def range_starts_sql(
    dialect: Dialect, schema: str, table: str, key: str, rows: int, percent: float | None = None
) -> str:
    """(key, row number) of the first row of every range of ``rows`` rows; with ``percent``
    of every range of ``rows`` rows of a sample, so that the database sorts no more than that.

    Equal row counts, unlike equal key widths, hold up when ids have gaps or
    clusters; and text keys split as well as numbers. The sample decides only where ranges
    begin. The database orders it, as the order of its texts may not be ours.
    """
    k = dialect.quote(check_identifier(key, "primary_key"))
    behind, also = ("", "") if percent is None else (c.format(percent=f"{percent:.6f}") for c in dialect.sample)
    return (
        "SELECT t.k AS start_key, t.r AS start_row FROM"
        f" (SELECT {k} AS k, ROW_NUMBER() OVER (ORDER BY {k}) AS r"
        f" FROM {dialect.table(schema, table)}{behind} WHERE {k} IS NOT NULL{also}) t"
        f" WHERE t.r - 1 = FLOOR((t.r - 1) / {rows}) * {rows}"
    )


def in_row_order(starts: Sequence[Sequence[Any]]) -> list[Any]:
    """Start keys in the order of the database, whose text order may not be ours."""
    return [key for key, _ in sorted(starts, key=lambda start: start[1])]


def parts_of(
    dialect: Dialect, condition: str, parts: int, split_by: str | None, what: str,
    columns: Sequence[str] = (),
) -> list[str]:
    """``condition`` in ``parts`` parts by the column ``split_by``, or by the identity of rows.
    Positions of rows would not do: they change between reads."""
    if parts <= 1:
        return [condition]
    if not split_by:
        log.warning("%s is one read of about %d reads' size; set split_by to split it", what, parts)
        return [condition]
    if split_by == ROW:
        return [f"({condition}) AND {dialect.part_of_rows(columns, parts, i)}" for i in range(parts)]
    return [f"({condition}) AND {dialect.part(split_by, parts, i)}" for i in range(parts)]


def range_predicates(
    dialect: Dialect, key: str, starts: Sequence[Any], split_by: str | None = None,
    columns: Sequence[str] = (),
) -> list[str]:
    """Conditions that put every row with a key in exactly one read, in key order.

    A key that starts several ranges is hot: its rows are reads of their own, as many as
    it has ranges, split by ``split_by``. Keys without a literal make one read.
    """
    k = dialect.quote(check_identifier(key, "primary_key"))
    sizes = Counter(starts)
    values = list(sizes)
    texts = [dialect.literal(v) for v in values]
    if None in texts or len(starts) < 2:
        return [f"{k} IS NOT NULL"]
    found = []
    for i, (value, low) in enumerate(zip(values, texts)):
        below = f"{k} < {texts[i + 1]}" if i + 1 < len(texts) else None
        if sizes[value] > 1:
            hot = parts_of(dialect, f"{k} = {low}", sizes[value], split_by, f"key {low}", columns)
            rest = f"{k} > {low}" + (f" AND {below}" if below else "")
            if i == 0:  # rows that come in below the first key while it is read
                found.append(f"{k} < {low}")
            found += [*hot, rest]
        elif i == 0:
            found.append(below)
        else:
            found.append(f"{k} >= {low}" + (f" AND {below}" if below else ""))
    return [p or f"{k} IS NOT NULL" for p in found]


def snapshot_of(
    dialect: Dialect, name: str, at: dt.datetime | None, changed_at: str | None
) -> tuple[str, str | None]:
    """(table, condition) that let all reads of a copy see the table as of ``at``.

    Without ``changed_at`` the database has to keep former rows (Oracle's undo, system-versioned
    tables of SQL Server and SAP HANA). With it, a column with the time of a row's last change,
    rows changed later are left to the next load.
    """
    if at is None:
        return name, None
    text = dialect.literal(at)
    if changed_at:
        column = dialect.quote(check_identifier(changed_at, "changed_at"))
        return name, f"({column} <= {text} OR {column} IS NULL)"
    if not dialect.as_of:
        raise ValueError("this database keeps no former rows: name a column as changed_at")
    return name + dialect.as_of.format(at=text), None


def read_table(
    spark: SparkSession,
    source: Connection,
    schema: str,
    table: str,
    primary_key: str | None = "id",
    rows_per_read: int = ROWS_PER_READ,
    max_reads: int = MAX_READS,
    split_by: str | None = None,
    at: dt.datetime | None = None,
    changed_at: str | None = None,
) -> DataFrame:
    """All rows and columns of a table, ordered by primary key; rows without key come last.

    Row ranges are read in key order and sorted inside, so the files written from the
    result follow the key. Their starts are taken from a sample of the keys where the table is
    large against it. What ranges cannot split (rows of one key, rows without key,
    tables without key or with a key of a type that has no literal) is split by the
    integer column ``split_by``, by the identity of rows if that is ``ROW`` (tables only, views
    have none), or read at once with a warning.

    Each read is a statement of its own: a table in use may change between them, and a row
    whose identity changes meanwhile may be read twice or not at all. ``at`` and ``changed_at``
    let them see one state (``snapshot_of``).
    """
    dialect, url, properties = source.dialect, source.url(schema), source.properties()
    name, state = snapshot_of(dialect, dialect.table(schema, table), at, changed_at)

    def rows(sql: str) -> DataFrame:
        return spark.read.jdbc(url, f"({sql}) q", properties=properties)

    if not primary_key and not split_by:
        log.warning("%s has neither key nor split_by and is one read, whatever its size", name)
        predicates = ["1 = 1"]
    else:
        total, keyed = map(int, rows(count_sql(dialect, schema, table, primary_key)).first())
        size = max(rows_per_read, -(-total // max_reads))
        reads = lambda n: -(-n // size)
        by_row = split_by == ROW and "{columns}" in dialect.row_hash and total > size
        columns = spark.read.jdbc(url, name, properties=properties).columns if by_row else ()
        if not primary_key:
            what = f"{name} (no key)"
            predicates = parts_of(dialect, "1 = 1", reads(total), split_by, what, columns)
        elif total <= size:
            predicates = ["1 = 1"]
        else:
            # At most about max_reads start keys come to the driver, never rows.
            percent, step = 100 * SAMPLED_PER_READ / size, SAMPLED_PER_READ
            if percent >= 50 or dialect.sample == ("", ""):
                percent, step = None, size
            found = rows(range_starts_sql(dialect, schema, table, primary_key, step, percent))
            starts = in_row_order(found.collect())
            predicates = range_predicates(dialect, primary_key, starts, split_by, columns)
            if len(predicates) == 1:
                what = f"{name} (key without literal)"
                predicates = parts_of(
                    dialect, predicates[0], reads(keyed), split_by, what, columns
                )
            if total > keyed:
                k, what = dialect.quote(primary_key), f"{name} (rows without key)"
                predicates += parts_of(
                    dialect, f"{k} IS NULL", reads(total - keyed), split_by, what, columns
                )
    if state:
        predicates = [f"({p}) AND {state}" for p in predicates]
    if predicates == ["1 = 1"] and not primary_key:
        return spark.read.jdbc(url, name, properties=properties)
    read = spark.read.jdbc(url, name, predicates=predicates, properties=properties)
    return read.sortWithinPartitions(f"`{primary_key}`") if primary_key else read
