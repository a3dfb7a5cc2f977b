"""Keyed state of the streams: what a batch needs from earlier ones, found by key."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed(spark: SparkSession):
    """Queries started inside keep their state in an embedded store on disk, written to the checkpoint by changes."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def rows_so_far(rows: DataFrame, key: str) -> DataFrame:
    """All rows that have arrived for the keys of a batch, those of the batch included. Rows are kept as JSON.

    The rows of a key come and go one by one: most keys have a few, too few for a frame of their own.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    # classes of this function travel to the workers by value: these need no copy of the package
    class SoFar(StatefulProcessor):
        def init(self, handle):
            self.kept = handle.getListState("rows", "row string")

        def handleInputRows(self, key, rows, timerValues):
            before = list(self.kept.get())
            arrived = [(r["row"],) for r in rows]
            self.kept.appendList(arrived)
            for part in (before, arrived):
                for r in part:
                    yield Row(key=key[0], row=r[0])

        def close(self):
            pass

    packed = rows.select(F.col(key).alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    kept = packed.groupBy("key").transformWithState(
        SoFar(), "key string, row string", outputMode="Update", timeMode="None")
    return kept.select(F.from_json("row", rows.schema).alias("r")).select("r.*")


def duplicate_hits(claims: DataFrame) -> DataFrame:
    """``claims(claim_id, submitted_at, invoice_number, invoice_date, invoice_amount)`` with ``dup_exact`` and ``dup_any``.

    These are the earliest registrations (by time and claim) of another claim before it, with all values that the
    claim has, and with its number alone. State of a number: while one claim holds it, that record; then a map of
    the records by claim, and the earliest one for each combination of date and amount, given or not. So a number
    that very many claims hold costs a few lookups for each new one. If a claim's record is replaced and was the
    earliest of a combination, that one is found anew among the records. Claims without a number keep no state.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    def keys(date, amount):
        """Combinations that a record is found under: which of date (1) and amount (2) belong to it."""
        out = [(0, "", "")]
        if date:
            out.append((1, date, ""))
        if amount:
            out.append((2, "", amount))
        if date and amount:
            out.append((3, date, amount))
        return out

    class Registry(StatefulProcessor):
        record = "at long, claim string, date string, amount string"

        def init(self, handle):
            # the only record; a record of no claim says that there are several
            self.only = handle.getValueState("only", self.record)
            self.records = handle.getMapState("records", "claim string", self.record)
            self.firsts = handle.getMapState("firsts", "mode int, date string, amount string", self.record)

        def put_first(self, key, record):
            now = self.firsts.getValue(key) if self.firsts.containsKey(key) else None
            if now is None or tuple(record) < tuple(now):
                self.firsts.updateValue(key, record)

        def add(self, record):
            """One of several records of the number."""
            _, claim, date, amount = record
            old = self.records.getValue((claim,)) if self.records.containsKey((claim,)) else None
            newer = lambda r: (r[0], r[2], r[3])
            if old is not None and newer(old) >= newer(record):
                return
            self.records.updateValue((claim,), record)
            for key in keys(date, amount):
                self.put_first(key, record)
            for key in keys(old[2], old[3]) if old is not None else []:
                if tuple(self.firsts.getValue(key)) != tuple(old):
                    continue
                own = [tuple(r) for _, r in self.records.iterator() if key in keys(r[2], r[3])]
                if own:
                    self.firsts.updateValue(key, min(own))
                else:
                    self.firsts.removeKey(key)

        def register(self, rows):
            now = self.only.get()
            several = now is not None and now[1] == ""
            for record in rows:
                if several:
                    self.add(record)
                elif now is None or now[1] == record[1]:
                    now = record if now is None or (now[0], now[2], now[3]) < (record[0], record[2], record[3]) else now
                else:
                    self.add(tuple(now))
                    self.add(record)
                    several = True
            self.only.update((0, "", "", "") if several else tuple(now))
            return several

        def handleInputRows(self, key, rows, timerValues):
            arrived = list(rows)
            records = [(r["at"], r["claim"], r["date"], r["amount"]) for r in arrived]
            several = self.register(records) if arrived[0]["number"] is not None else False
            firsts = {}

            def before(mode, record):
                """The earliest record of a combination, if it is another claim's before this one; else nothing."""
                if not several:
                    return nothing
                if mode not in firsts:
                    firsts[mode] = tuple(self.firsts.getValue(mode)) if self.firsts.containsKey(mode) else None
                first = firsts[mode]
                return first if first is not None and first[1] != record[1] and first[:2] < record[:2] else nothing

            nothing = (None, None, None, None)
            for row, record in zip(arrived, records):
                exact, other = before(keys(record[2], record[3])[-1], record), before((0, "", ""), record)
                yield out(row["key"], row["row"], *exact, *other)

        def close(self):
            pass

    none = F.lit("")
    at = F.unix_micros(F.col("submitted_at").cast("timestamp"))
    packed = claims.select(
        # claims without a number are spread by their own ids
        F.coalesce("invoice_number", F.concat(F.lit("\0"), F.coalesce("claim_id", none))).alias("key"),
        F.col("invoice_number").alias("number"), F.coalesce(at, F.lit(-(2 ** 62))).alias("at"), F.coalesce("claim_id", none).alias("claim"),
        F.coalesce("invoice_date", none).alias("date"), F.coalesce("invoice_amount", none).alias("amount"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    names = [f"{k}_{n}" for k in ("exact", "any") for n in ("at", "claim", "date", "amount")]
    out = Row("key", "row", *names)
    columns = ", ".join(f"{n} {'long' if n.endswith('_at') else 'string'}" for n in names)
    found = packed.groupBy("key").transformWithState(
        Registry(), f"key string, row string, {columns}", outputMode="Update", timeMode="None")

    def hit(kind, name):
        record = F.struct(F.timestamp_micros(f"{kind}_at").cast("timestamp_ntz").alias("created_at"), F.col(f"{kind}_claim").alias("claim_id"),
                          F.nullif(f"{kind}_date", none).alias("invoice_date"), F.nullif(f"{kind}_amount", none).alias("invoice_amount"))
        return F.when(F.col(f"{kind}_claim").isNotNull(), record).alias(name)

    return found.select(F.from_json("row", claims.schema).alias("r"), hit("exact", "dup_exact"), hit("any", "dup_any")).select(
        "r.*", "dup_exact", "dup_any")
