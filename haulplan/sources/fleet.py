"""Fleet and goods dimensions: small fixed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vehicle:
    name: str
    vehicle_no: str
    max_kg: int
    cost_per_km: int
    l: int
    w: int
    h: int
    volume_m3: float
    axles: int
    truck_class: str
    fixed_cost_per_trip: int
    fuel_efficiency_kmpl: float
    co2_per_km_kg: float
    co2_per_ton_km: float

    @property
    def hold_cm3(self) -> float:
        return float(self.l) * self.w * self.h


# The twelve vehicle types.
FLEET = (
    Vehicle("Tata Ace (Mini Truck)", "MH-04-AB-1001", 750, 18, 180, 140, 120, 3.02, 2, "LCV", 500, 18.0, 0.18, 0.062),
    Vehicle("Tata 407 (LCV)", "MH-04-AB-1002", 2000, 28, 290, 175, 150, 7.61, 2, "LCV", 700, 14.0, 0.22, 0.058),
    Vehicle("Ashok Leyland Dost", "MH-04-AB-1003", 1500, 25, 250, 160, 140, 5.60, 2, "LCV", 650, 15.5, 0.20, 0.060),
    Vehicle("Eicher 20ft", "MH-04-AB-1004", 7500, 45, 600, 230, 220, 30.36, 3, "ICV", 1200, 9.0, 0.45, 0.048),
    Vehicle("Mahindra Bolero Pickup", "MH-04-AB-1005", 1200, 22, 320, 180, 160, 9.22, 2, "ICV", 800, 13.0, 0.25, 0.055),
    Vehicle("Eicher 19ft", "MH-04-AB-1006", 9000, 48, 580, 210, 210, 25.60, 3, "ICV", 1300, 8.5, 0.48, 0.046),
    Vehicle("Ashok Leyland 32ft", "MH-04-AB-1234", 15000, 65, 975, 245, 240, 57.29, 4, "HCV", 1800, 6.5, 0.68, 0.038),
    Vehicle("Volvo FH 40ft (FTL)", "MH-04-AB-5678", 22000, 95, 1200, 245, 270, 79.38, 5, "HCV", 2500, 4.5, 0.95, 0.032),
    Vehicle("BharatBenz 32ft MXL", "MH-04-AB-9999", 16000, 68, 980, 250, 245, 60.00, 4, "HCV", 1900, 6.2, 0.70, 0.036),
    Vehicle("32ft Single Axle (SXL)", "MH-04-AB-2001", 9500, 52, 975, 240, 235, 54.93, 3, "HCV", 1500, 7.8, 0.55, 0.042),
    Vehicle("32ft Multi Axle (MXL)", "MH-04-AB-2002", 16000, 70, 975, 245, 240, 57.29, 4, "HCV", 2000, 6.0, 0.72, 0.035),
    Vehicle("24ft Multi Axle", "MH-04-AB-2003", 12000, 58, 730, 240, 235, 41.13, 3, "ICV", 1600, 7.2, 0.60, 0.040),
)

# Smallest payload first; the file order decides between equal payloads.
BY_PAYLOAD = tuple(sorted(FLEET, key=lambda v: v.max_kg))
LARGEST = BY_PAYLOAD[-1]

REQUIRED = (
    "name", "vehicle_no", "max_kg", "l", "w", "h", "fixed_cost_per_trip",
    "cost_per_km", "co2_per_km_kg", "co2_per_ton_km", "truck_class",
)

# Goods type -> (must stand upright, kilograms allowed on top).
STACKING = {
    "pharma_medical": (True, 500.0),
    "electronics": (False, 800.0),
    "chemicals_industrial": (True, 2000.0),
    "fmcg_packaged_goods": (False, 5000.0),
    "textiles_apparel": (False, 8000.0),
    "automotive_parts": (False, 15000.0),
    "steel_metal_parts": (False, 0.0),
    "construction_material": (False, 0.0),
}
STACKING_DEFAULT = (False, 15000.0)


def fleet_df(spark: SparkSession) -> DataFrame:
    """The fleet as a 12-row DataFrame with ``fleet_ord`` (file order)."""
    rows = [
        (i, v.name, v.vehicle_no, v.max_kg, v.cost_per_km, v.l, v.w, v.h, v.volume_m3,
         v.axles, v.truck_class, v.fixed_cost_per_trip, v.fuel_efficiency_kmpl,
         v.co2_per_km_kg, v.co2_per_ton_km)
        for i, v in enumerate(FLEET)
    ]
    return spark.createDataFrame(
        rows,
        "fleet_ord int, name string, vehicle_no string, max_kg int, cost_per_km int, "
        "l int, w int, h int, volume_m3 double, axles int, truck_class string, "
        "fixed_cost_per_trip int, fuel_efficiency_kmpl double, co2_per_km_kg double, "
        "co2_per_ton_km double",
    )


def incomplete_vehicles(fleet: DataFrame) -> DataFrame:
    """Vehicles that lack a required field; must be empty."""
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    )
    return fleet.select("name", missing.alias("missing")).filter(F.size("missing") > 0)
