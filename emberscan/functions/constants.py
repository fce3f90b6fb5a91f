"""Fixed physical and domain values."""

# Physics (SI units).
PLANCK_H = 6.62607015e-34
LIGHT_C = 2.99792458e8
BOLTZMANN_K = 1.380649e-23
STEFAN_BOLTZMANN = 5.670374419e-8
WIEN_B = 2.897771955e-3

# Band centre wavelengths in metres.
WAVELENGTHS = {
    "M07": 0.865e-6,
    "M08": 1.240e-6,
    "M10": 1.610e-6,
    "M11": 2.250e-6,
    "M12": 3.700e-6,
    "M13": 4.050e-6,
    "M14": 8.550e-6,
}
BANDS = list(WAVELENGTHS)
SWIR_BANDS = ["M07", "M08", "M10", "M11"]
MWIR_BANDS = ["M12", "M13"]

# Across-track zones [start, end).
ZONES = [(0, 640), (640, 1008), (1008, 2192), (2192, 2560), (2560, 3200)]

# Basin boxes in order of precedence (south, north, west, east).
BASINS = [
    ("Permian", 30.0, 33.5, -104.5, -100.5),
    ("Eagle Ford", 27.5, 30.0, -100.5, -96.0),
    ("Haynesville", 31.5, 33.5, -95.5, -92.5),
    ("San Juan", 36.0, 37.5, -109.0, -107.0),
    ("Uinta", 39.5, 40.5, -111.0, -109.0),
    ("Bakken", 46.0, 49.0, -105.5, -102.0),
    ("DJ/Niobrara", 39.0, 42.5, -105.5, -103.0),
    ("Powder River", 42.5, 46.0, -107.0, -104.5),
    ("Anadarko/SCOOP/STACK", 34.0, 37.0, -100.0, -97.0),
    ("Marcellus/Utica", 38.5, 42.5, -82.0, -77.0),
    ("Williston", 46.0, 49.0, -106.0, -101.0),
    ("Appalachian", 37.0, 43.0, -83.0, -76.0),
]
CONUS = (27.5, 49.0, -111.0, -76.0)

# Source classes by temperature, strictly above.
CLASSES = [
    (1400, "gas_flare"),
    (1000, "industrial_or_large_fire"),
    (700, "biomass_burning"),
    (500, "smoldering"),
]
COLDEST_CLASS, FAILED_CLASS = "low_temperature_anomaly", "fit_failed"

# Detection, calibration, geometry, volume.
NIGHT_ZENITH = 100.0
CLIP_SIGMA, CLIP_ROUNDS, HOT_SIGMA, LOCAL_SIGMA = 5.0, 3, 4.0, 3.0
HALF_WINDOW, LEAST_BACKGROUND = 5, 5
FILL_VALUE, VALID_MAX = 65535, 65527
PIXEL_AREA_M2 = 562500.0
SITE_STEP = 0.0075
BCM_PER_MW = 0.029353
MMSCF_PER_BCM = 35314.667
FIT_T = (400.0, 4000.0)
FIT_ESF = (1e-15, 1.0)
FIT_START_T = 1800.0
