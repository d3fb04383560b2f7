"""Expressions that Spark and the checking engine spell differently, so that one query text serves both."""

from __future__ import annotations


class Spark:
    name = "spark"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def octets(self, x: str) -> str:
        return f"octet_length({x})"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE '{pattern}')"

    def lines(self, x: str) -> str:
        return f"split({x}, '\\n')"

    def split(self, x: str, mark: str) -> str:
        return f"split({x}, '[{mark}]')"

    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)"

    def joined(self, x: str, order: str, mark: str = ",") -> str:
        return f"listagg({x}, '{mark}') WITHIN GROUP (ORDER BY {order})"

    def each(self, source: str, array: str, place: str, value: str) -> str:
        return f"(SELECT *, CAST({place}_ AS BIGINT) AS {place} FROM {source} LATERAL VIEW posexplode({array}) x_ AS {place}_, {value})"

    def numbers(self, source: str, low: str, high: str, value: str) -> str:
        return f"(SELECT *, CAST({value}_ AS BIGINT) AS {value} FROM {source} LATERAL VIEW explode(CASE WHEN {high} >= {low} THEN sequence({low}, {high}) ELSE array() END) x_ AS {value}_)"

    def first_match(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def all_matches(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, '{pattern}', {group})"

    def replaced(self, x: str, pattern: str, put: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{put}')"

    def at(self, array: str, place: str) -> str:
        return f"get({array}, {place} - 1)"

    def part(self, array: str, n: int) -> str:
        """The first n members."""
        return f"slice({array}, 1, {n})"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"

    def escaped(self, pattern: str) -> str:
        """A pattern with backslashes, for a literal."""
        return pattern.replace("\\", "\\\\")

    def plan(self, mine, plain) -> str:
        """A part of a text in the library's form, or for the check as a plain reading that is written apart."""
        return mine(self)

    def seconds(self, later: str, earlier: str) -> str:
        return f"CAST(timestampdiff(SECOND, {earlier}, {later}) AS BIGINT)"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '$.{path}')"

    def edit_distance(self, a: str, b: str) -> str:
        return f"levenshtein({a}, {b})"

    def disc(self, p: float, x: str) -> str:
        return f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})"

    def days(self, ts: str, n: str) -> str:
        return f"date_add(CAST({ts} AS DATE), CAST({n} AS INT))"


class Duck(Spark):
    name = "duck"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def octets(self, x: str) -> str:
        return f"octet_length(encode({x}))"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def lines(self, x: str) -> str:
        return f"string_split({x}, chr(10))"

    def split(self, x: str, mark: str) -> str:
        return f"string_split({x}, '{mark}')"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS BIGINT)"

    def joined(self, x: str, order: str, mark: str = ",") -> str:
        return f"string_agg({x}, '{mark}' ORDER BY {order})"

    def each(self, source: str, array: str, place: str, value: str) -> str:
        return f"(SELECT s_.*, x_.{value}, x_.{place} FROM (SELECT *, {array} AS a_ FROM {source}) s_, LATERAL (SELECT unnest(s_.a_) AS {value}, unnest(range(len(s_.a_))) AS {place}) x_)"

    def numbers(self, source: str, low: str, high: str, value: str) -> str:
        return f"(SELECT s_.*, x_.{value} FROM (SELECT *, range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1) AS a_ FROM {source}) s_, LATERAL (SELECT unnest(s_.a_) AS {value}) x_)"

    def replaced(self, x: str, pattern: str, put: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{put}', 'g')"

    def at(self, array: str, place: str) -> str:
        return f"({array})[{place}]"

    def part(self, array: str, n: int) -> str:
        return f"({array})[1:{n}]"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def escaped(self, pattern: str) -> str:
        return pattern

    def terms(self, x: str) -> str:
        """What the analyser gives where no character has a compatibility form: identifiers, and other letters and digits."""
        return self.all_matches(f"replace(lower({x}), chr(223), 'ss')", r"[0-9A-Za-z]+(?:[._+#&-]+[0-9A-Za-z]+)*|[^\x00-\x7F\pP\pS\pZ\pM\pC]+")

    def plan(self, mine, plain) -> str:
        return plain(self)

    def seconds(self, later: str, earlier: str) -> str:
        return f"CAST(date_diff('second', {earlier}, {later}) AS BIGINT)"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '$.{path}')"

    def days(self, ts: str, n: str) -> str:
        return f"CAST(CAST({ts} AS DATE) + CAST({n} AS INT) AS DATE)"


SPARK, DUCK = Spark(), Duck()
