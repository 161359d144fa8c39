"""Small base tables from short rows."""

from datetime import date, datetime
from decimal import Decimal

from turnstile import schemas
from turnstile.sources.reference import literal_table

SF_SMALL = "/root/testdata/sf0.001"


class Maker:
    """Small base tables from short rows."""

    def __init__(self, spark):
        self.spark = spark

    def rides(self, *rows):
        """(txid, rfid, resort, lift, time, activation day)."""
        full = [(t, r, s, lift, at(time), n) for t, r, s, lift, time, n in rows]
        return self.spark.createDataFrame(full, schemas.LIFT_RIDE)

    def passes(self, *rows):
        """(rfid, price, purchase day, expiry)."""
        full = [
            (f"p{i}", r, at(f"{bought} 00:00:00"), Decimal(price), day(until), f"holder {r}",
             None, None, None, None)
            for i, (r, price, bought, until) in enumerate(rows)
        ]
        return self.spark.createDataFrame(full, schemas.SEASON_PASS)

    def tickets(self, *rows):
        """(rfid, resort, price, days, purchase day, expiry)."""
        full = [
            (f"t{i}", r, s, at(f"{bought} 00:00:00"), Decimal(price), day(until), n, f"guest {r}",
             None, None, None, None)
            for i, (r, s, price, n, bought, until) in enumerate(rows)
        ]
        return self.spark.createDataFrame(full, schemas.RESORT_TICKET)

    def capacity(self, *rows):
        """(resort, most visitors, zone)."""
        full = [(s, most, 1, 1, zone) for s, most, zone in rows]
        return literal_table(self.spark, full, schemas.RESORT_CAPACITY)

    def visits(self, *rows):
        """(resort, rfid, first ride, pass?, price, usage, days)."""
        full = [
            (at(first).date(), s, r, f"name {r}", at(first), "lift", on_pass,
             None if price is None else Decimal(price), usage, days)
            for s, r, first, on_pass, price, usage, days in rows
        ]
        return self.spark.createDataFrame(full, schemas.DAILY_VISITS)


def at(text):
    return None if text is None else datetime.fromisoformat(text)


def day(text):
    return date.fromisoformat(text)


def rows_of(df, *names):
    return sorted(tuple(row[n] for n in names) for row in df.select(*names).collect())
