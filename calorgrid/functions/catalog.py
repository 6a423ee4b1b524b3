"""The pipe catalogue and the prices, widths and factors that depend on a pipe or on what it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Dn, capacity t/h, longest path m, price of a metre new and rebuilt, shell, gap, width, height m.
PIPES = (
    (50, "3.5", "181", "74023", "96180", "0.125", "0.150", "0.400", "0.125"),
    (65, "8.3", "245", "78631", "109989", "0.140", "0.150", "0.430", "0.140"),
    (80, "13.2", "327", "83530", "117582", "0.160", "0.150", "0.470", "0.160"),
    (100, "22.3", "419", "89748", "133694", "0.180", "0.150", "0.510", "0.180"),
    (125, "40.2", "554", "97275", "148030", "0.225", "0.150", "0.600", "0.225"),
    (150, "65.1", "696", "105507", "152295", "0.250", "0.150", "0.650", "0.250"),
    (200, "152.3", "1042", "120275", "181766", "0.315", "0.250", "0.880", "0.315"),
    (250, "274.9", "1379", "135323", "202030", "0.400", "0.250", "1.050", "0.400"),
    (300, "437.4", "1718", "150022", "228707", "0.450", "0.250", "1.150", "0.450"),
    (400, "943.1", "2477", "190299", "271317", "0.560", "0.250", "1.370", "0.560"),
    (500, "1663.4", "3245", "224137", "333884", "0.710", "0.250", "1.670", "0.710"),
    (600, "2627.7", "4037", "264790", "372703", "0.800", "0.250", "1.850", "0.800"),
    (700, "3735.1", "4775", "324298", "439571", "0.900", "0.250", "2.050", "0.900"),
    (800, "5296.8", "5644", "325996", "489918", "1.000", "0.250", "2.250", "1.000"),
    (900, "7165.0", "6518", "327693", "553607", "1.100", "0.250", "2.450", "1.100"),
    (1000, "9391.8", "7419", "418777", "606679", "1.200", "0.250", "2.650", "1.200"),
    (1200, "15012.8", "9288", "428074", "825692", "1.425", "0.250", "3.100", "1.425"),
    (1400, "22501.9", "11276", "683417", "978584", "1.600", "0.250", "3.450", "1.600"),
)
COLUMNS = ("dn", "capacity", "max_length", "new_price", "rebuild_price", "shell", "gap", "width", "height")
# Clear distance m, price factor, straight run m on each side, own width m of what a pipe passes.
BUILDING_CLEARANCE = ((500, "5"), (900, "7"), (None, "9"))
CLEARANCE = {"road": "1.5", "tram_tracks": "1.5", "gas_pipeline": "2", "power_cable": "2"}
FACTOR = {"road": "1.6", "tram_tracks": "1.75", "gas_pipeline": "1.25", "power_cable": "1.15", "heat_network": "1.05"}
EXTENSION = {"road": 3, "tram_tracks": 3}
OWN_WIDTH = {"gas_pipeline": "0.4", "power_cable": "0.2"}
# Price of a chamber up to a dn, of a tie-in, penalties.
CHAMBER_PRICE = ((200, 3_000_000), (500, 5_000_000), (1000, 8_000_000), (None, 12_000_000))
TIE_IN_PRICE = 5_000_000
# Names of restrictions and the kind that each is.
VOCABULARY = {
    "oks": "building", "building": "building", "oks_existing": "building", "social_area": "social_area",
    "school": "social_area", "kindergarten": "social_area", "water": "water", "park": "park",
    "prohibited_site": "prohibited_site", "road": "road", "tram_tracks": "tram_tracks",
    "gas_pipeline": "gas_pipeline", "power_cable": "power_cable", "railway": "railway", "metro": "metro",
    "heat_network": "heat_network",
}

VALUES_SQL = "(VALUES " + ", ".join(f"({p[0]}, CAST({p[1]} AS DECIMAL(12,2)), CAST({p[2]} AS DECIMAL(18,9)), CAST({p[3]} AS DECIMAL(12,2)), CAST({p[4]} AS DECIMAL(12,2)), CAST({p[7]} AS DECIMAL(6,3)))" for p in PIPES) + ") AS catalog(dn, capacity, max_length, new_price, rebuild_price, width)"


def frame(spark: SparkSession) -> DataFrame:
    """The catalogue as a table of 18 rows."""
    return spark.sql(f"SELECT * FROM {VALUES_SQL}")


def step(value: Column, bounds, of=lambda x: F.lit(x)) -> Column:
    """The entry of the first bound that the value doesn't exceed; the last bound is open."""
    out = None
    for top, what in bounds:
        if top is None:
            out = of(what) if out is None else out.otherwise(of(what))
        else:
            out = F.when(value <= top, of(what)) if out is None else out.when(value <= top, of(what))
    return out


def base_dn(flow: Column) -> Column:
    """The least dn that carries a flow; null beyond the catalogue and below zero. No join: 18 literals."""
    out = F.when(flow < 0, F.lit(None).cast("int"))
    for p in PIPES:
        out = out.when(flow <= F.lit(p[1]).cast("decimal(12,2)"), F.lit(p[0]))
    return out


def at_least_dn(value: Column) -> Column:
    """The least dn of the catalogue not below a value; the largest if none is."""
    return step(value, [(p[0], p[0]) for p in PIPES[:-1]] + [(None, PIPES[-1][0])])


def next_dn(dn: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for a, b in zip(PIPES, PIPES[1:]) for x in (a[0], b[0])]), dn)


def of_pipe(dn: Column, column: str, kind: str) -> Column:
    """A catalogue column of a dn, as a decimal type."""
    k = COLUMNS.index(column)
    return F.element_at(F.create_map(*[x for p in PIPES for x in (F.lit(p[0]), F.lit(p[k]).cast(kind))]), dn)


def chamber_price(dn: Column) -> Column:
    return step(dn, CHAMBER_PRICE)


def by_kind(kind: Column, values: dict[str, str], other: str, type_: str = "decimal(6,3)") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(str(v)).cast(type_))]), kind), F.lit(other).cast(type_))


def clearance(kind: Column, dn: Column) -> Column:
    d = lambda x: F.lit(x).cast("decimal(6,3)")
    building = F.when(dn < 500, d("5")).when(dn < 900, d("7")).otherwise(d("9"))
    return F.when(kind == "building", building).otherwise(by_kind(kind, CLEARANCE, "1"))


def required_distance(kind: Column, dn: Column, width: Column) -> Column:
    """Between axis and object: the clearance and half of both widths."""
    return clearance(kind, dn) + of_pipe(dn, "width", "decimal(6,3)") / 2 + width / 2


def crossing_factor(kind: Column) -> Column:
    return by_kind(kind, FACTOR, "1", "decimal(4,2)")


def kind_of(name: Column) -> Column:
    """The kind that a restriction's name stands for; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in VOCABULARY.items() for x in kv]), F.lower(F.trim(name)))
