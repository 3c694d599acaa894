"""What can be set: ``quernstone.*`` keys of the Spark session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from quernstone.errors import EngineError


@dataclass(frozen=True)
class Settings:
    """A field ``x`` is the key ``quernstone.x``.

    ``most_parts``: small folders of a table from which an insert gathers the smallest.
    ``compact_parts``: small folders of a table from which a checkpoint gathers them.
    ``vacuum_grace_seconds``: age from which a checkpoint deletes what no commit names;
    a transaction that stays open for longer may fail at its commit.
    ``fk_restrict``: deletes and drops may not leave orphans (off: they may).
    """

    most_parts: int = 32
    compact_parts: int = 8
    vacuum_grace_seconds: int = 3600
    fk_restrict: bool = False

    @staticmethod
    def of(spark: SparkSession, **given) -> Settings:
        """The session's settings; those given (and not None) come first."""
        found = {}
        for f in fields(Settings):
            text = spark.conf.get(f"quernstone.{f.name}", None)
            if given.get(f.name) is not None:
                found[f.name] = given[f.name]
            elif text is not None:
                found[f.name] = _read(f.name, text, isinstance(f.default, bool))
        return Settings(**found)


def _read(name: str, text: str, flag: bool) -> int | bool:
    if flag and text.lower() in ("true", "false"):
        return text.lower() == "true"
    if not flag and text.isdecimal() and (int(text) > 0 or name == "vacuum_grace_seconds"):
        return int(text)
    raise EngineError(f"quernstone.{name}: {text!r}")
