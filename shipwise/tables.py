"""The bundle of nine marketplace tables every operator takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "category_translation", "customers", "sellers", "products", "orders",
    "order_items", "order_payments", "order_reviews", "geolocation",
)


class Tables:
    """DataFrames of the nine tables (``geolocation`` may be None).

    A table may be given as a zero-argument function instead of a DataFrame;
    it is then built on first access (for tables whose construction runs a
    job, so operators that never read them do not pay for it). ``item_rows``
    may give the order items without their number where numbering costs
    something; operators that do not use the number read that frame.
    """

    def __init__(self, item_rows: DataFrame | None = None, **frames):
        unknown = set(frames) - set(TABLE_NAMES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        missing = set(TABLE_NAMES) - set(frames) - {"geolocation"}
        if missing:
            raise TypeError(f"missing tables: {sorted(missing)}")
        self._frames = {n: frames.get(n) for n in TABLE_NAMES}
        self._item_rows = item_rows

    def __getattr__(self, name: str):
        frames = self.__dict__.get("_frames")
        if frames is None or name not in frames:
            raise AttributeError(name)
        v = frames[name]
        if v is not None and not isinstance(v, DataFrame) and callable(v):
            v = frames[name] = v()
        return v

    @property
    def item_rows(self) -> DataFrame:
        """The order items without ``order_item_id``."""
        return self.order_items.drop("order_item_id") if self._item_rows is None else self._item_rows

    def items(self):
        for name in TABLE_NAMES:
            df = getattr(self, name)
            if df is not None:
                yield name, df

    def unnumbered(self):
        """The tables by name, the order items without their number (which may cost a sort)."""
        for name in TABLE_NAMES:
            df = self.item_rows if name == "order_items" else getattr(self, name)
            if df is not None:
                yield name, df

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession


def persisted(t: Tables, names=("orders", "order_items", "order_reviews"), level=None) -> Tables:
    """A bundle whose ``names`` tables are persisted (default MEMORY_AND_DISK),
    for running many analyses over the same tables; ``unpersist_all`` undoes it."""
    from pyspark import StorageLevel
    level = level or StorageLevel.MEMORY_AND_DISK
    return Tables(**{n: (df.persist(level) if n in names else df) for n, df in t.items()})


def unpersist_all(t: Tables) -> None:
    for _, df in t.items():
        if df.is_cached:
            df.unpersist()


def register_views(t: Tables, prefix: str = "") -> list[str]:
    """Register every table as a temp view (``prefix + name``); returns names."""
    names = []
    for name, df in t.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def tables_from_views(spark: SparkSession, prefix: str = "") -> Tables:
    """Rebuild the bundle from views or catalog tables named ``prefix + name``."""
    have = {x.name for x in spark.catalog.listTables()}
    kw = {n: (spark.table(prefix + n) if (prefix + n) in have else None) for n in TABLE_NAMES}
    return Tables(**kw)
