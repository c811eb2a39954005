"""Fixed values of the surveillance domain: column names, code lists, thresholds.

Everything here is data. Operators take column names and thresholds as
arguments and use these values as their defaults.
"""

from __future__ import annotations

# --- Fixed values: canonical case columns, in order -------------------------
CANONICAL_COLUMNS = [
    "CONSECUTIVE", "COD_EVE", "Nombre_evento", "FEC_NOT", "SEMANA", "ANO",
    "INI_SIN", "EDAD", "UNI_MED", "SEXO", "estrato", "TIP_SS", "TIP_CAS",
    "PAC_HOS", "CON_FIN", "GP_GESTAN", "AREA", "COD_DPTO_O", "COD_MUN_O",
    "Departamento_ocurrencia", "Municipio_ocurrencia",
    "Departamento_residencia", "Municipio_residencia", "nom_est_f_caso",
    "confirmados",
]
LINEAGE_COLUMNS = ["enfermedad", "source_name", "source_file"]

# --- Fixed values: header aliases, already normalised -----------------------
HEADER_ALIASES = {
    "CONSECUTIVE": ["CONSECUTIVE", "CONSECUTIVO", "ID", "ID_CASO", "CODIGO_CASO"],
    "COD_EVE": ["COD_EVE", "COD_EVENTO", "CODIGO_EVENTO", "EVENTO"],
    "Nombre_evento": ["NOMBRE_EVENTO", "NOM_EVE", "NOM_EVENTO", "EVENTO_NOMBRE"],
    "FEC_NOT": ["FEC_NOT", "FECHA_NOTIFICACION", "FECHA_DE_NOTIFICACION"],
    "SEMANA": ["SEMANA", "SEMANA_EPIDEMIOLOGICA", "SEM_EPI"],
    "ANO": ["ANO", "ANIO", "YEAR"],
    "INI_SIN": ["INI_SIN", "FECHA_INICIO_SINTOMAS", "INICIO_SINTOMAS"],
    "EDAD": ["EDAD"],
    "UNI_MED": ["UNI_MED", "UNIDAD_MEDIDA", "UNIDAD_EDAD"],
    "SEXO": ["SEXO", "GENERO"],
    "estrato": ["ESTRATO", "ESTRATO_SOCIOECONOMICO"],
    "TIP_SS": ["TIP_SS", "TIPO_SS", "SEGURIDAD_SOCIAL", "REGIMEN"],
    "TIP_CAS": ["TIP_CAS", "TIPO_CASO", "CLASIFICACION_CASO"],
    "PAC_HOS": ["PAC_HOS", "HOSPITALIZADO", "PACIENTE_HOSPITALIZADO"],
    "CON_FIN": ["CON_FIN", "CONDICION_FINAL"],
    "GP_GESTAN": ["GP_GESTAN", "GESTANTE"],
    "AREA": ["AREA", "AREA_RESIDENCIA"],
    "COD_DPTO_O": [
        "COD_DPTO_O", "COD_DEPTO_O", "COD_DPTO_OCURRENCIA",
        "CODIGO_DEPARTAMENTO_OCURRENCIA",
    ],
    "COD_MUN_O": [
        "COD_MUN_O", "COD_MPIO_O", "COD_MUNICIPIO_OCURRENCIA",
        "CODIGO_MUNICIPIO_OCURRENCIA",
    ],
    "Departamento_ocurrencia": [
        "DEPARTAMENTO_OCURRENCIA", "DEPTO_OCURRENCIA", "NOM_DPTO_O", "DEPARTAMENTO",
    ],
    "Municipio_ocurrencia": ["MUNICIPIO_OCURRENCIA", "NOM_MUN_O", "MUNICIPIO"],
    "Departamento_residencia": ["DEPARTAMENTO_RESIDENCIA", "NOM_DPTO_R"],
    "Municipio_residencia": ["MUNICIPIO_RESIDENCIA", "NOM_MUN_R"],
    "nom_est_f_caso": ["NOM_EST_F_CASO", "ESTADO_FINAL_CASO"],
    "confirmados": ["CONFIRMADOS", "CONFIRMADO"],
}

# --- Fixed values: missing-text tokens and sentinels ------------------------
MISSING_TOKENS = [
    "", "NA", "N/A", "NAN", "NONE", "NULL", "SIN DATO", "SIN_DATO",
    "NO APLICA", "NO APLICA.", "SD",
]
NO_DATA = "SIN_DATO"
NO_LABEL = "Sin dato"

# --- Fixed values: which columns get which cleaning rule --------------------
DATE_COLUMNS = ["FEC_NOT", "INI_SIN"]
INTEGER_COLUMNS = [
    "COD_EVE", "SEMANA", "ANO", "EDAD", "UNI_MED", "TIP_CAS", "PAC_HOS",
    "CON_FIN", "GP_GESTAN", "AREA", "confirmados",
]
TEXT_COLUMNS = [
    "CONSECUTIVE", "Nombre_evento", "SEXO", "TIP_SS",
    "Departamento_ocurrencia", "Municipio_ocurrencia",
    "Departamento_residencia", "Municipio_residencia", "nom_est_f_caso",
    "enfermedad", "source_name", "source_file",
]
CODE_WIDTHS = {"COD_DPTO_O": 2, "COD_MUN_O": 5}
FILLED_COLUMNS = [
    "Departamento_ocurrencia", "Municipio_ocurrencia",
    "Departamento_residencia", "Municipio_residencia", "SEXO",
]
DERIVED_COLUMNS = [
    "edad_anos", "grupo_etario", "tipo_caso", "condicion_final",
    "hospitalizado", "area_residencia", "unidad_edad", "regimen_salud",
    "dias_notificacion",
]

# --- Fixed values: accepted ranges ------------------------------------------
STRATUM_RANGE = (0, 6)
WEEK_RANGE = (1, 53)
YEAR_RANGE = (2000, 2100)
AGE_RANGE = (0, 120)
DELAY_RANGE = (0, 365)

# --- Fixed values: code lists -----------------------------------------------
SEX_RECODE = {"FEMENINO": "F", "MASCULINO": "M", "HOMBRE": "M", "MUJER": "F"}
CASE_TYPES = {
    1: "Sospechoso", 2: "Probable", 3: "Confirmado_Lab", 4: "Confirmado_Clinico",
}
FINAL_CONDITIONS = {1: "Vivo", 2: "Muerto"}
HOSPITAL_STATUS = {1: "Hospitalizado", 2: "No hospitalizado"}
RESIDENCE_AREAS = {
    1: "Cabecera municipal", 2: "Rural disperso", 3: "Centro poblado",
}
AGE_UNITS = {1: "Años", 2: "Meses", 3: "Días", 4: "Horas"}
INSURANCE_TYPES = {
    "C": "Contributivo", "S": "Subsidiado", "E": "Excepcion", "P": "Especial",
    "I": "Indeterminado", "N": "No asegurado",
}
UNITS_PER_YEAR = {2: 12.0, 3: 365.0, 4: 8760.0}
CONFIRMED_CASE_TYPES = [3, 4]
CONFIRMED_WORD = "CONFIRMADO"

# --- Fixed values: age groups (upper bound inclusive) -----------------------
AGE_GROUPS = [(4, "0-4"), (14, "5-14"), (29, "15-29"), (44, "30-44"), (59, "45-59")]
AGE_GROUP_LAST = "60+"
AGE_GROUP_ORDER = ["0-4", "5-14", "15-29", "30-44", "45-59", "60+", "Sin dato"]

# --- Fixed values: risk and outbreak labels ---------------------------------
RISK_LABELS = [(50, "bajo"), (200, "medio")]
RISK_LABEL_LAST = "alto"
OUTBREAK_LEVELS = [(5, "Sin brote relevante"), (25, "Brote bajo"), (75, "Brote medio")]
OUTBREAK_LEVEL_LAST = "Brote alto"
ALERT_SEVERITY = ["NINGUNO", "BAJO", "MEDIO", "ALTO"]

# --- Fixed values: disease name synonyms ------------------------------------
DISEASE_NAMES = {
    "DENGUE": "Dengue", "CHIKUNGUNYA": "Chikungunya",
    "CHIKUNGUYA": "Chikungunya", "MALARIA": "Malaria",
    "MALARIA VIVAX": "Malaria",
}

# --- Fixed values: configured sources ---------------------------------------
SOURCE_COLUMNS = ["disease", "slug", "year", "event_code", "source", "filename"]
SOURCES = [
    ("Dengue", "dengue", 2024, 210, "medata", "sivigila_dengue_medata_2024.csv"),
    ("Dengue", "dengue", 2024, 210, "ins_sivigila", "Datos_2024_210.xlsx"),
    ("Chikungunya", "chikungunya", 2024, 217, "medata", "sivigila_chikungunya_medata_2024.csv"),
    ("Chikungunya", "chikungunya", 2024, 217, "ins_sivigila", "Datos_2024_217.xlsx"),
    ("Malaria", "malaria", 2024, 490, "ins_sivigila", "Datos_2024_490.xlsx"),
]
MIN_FILE_BYTES = 100
CACHED_FILE_BYTES = 1000
SIGNATURE_BYTES = 500

# --- Fixed values: cell texts a CSV scan reads as null ----------------------
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- Fixed values: seasons and climate --------------------------------------
RAINY_MONTHS = [4, 5, 10, 11]
HIGH_TRANSMISSION_MONTHS = [3, 4, 5, 6, 10, 11]
TROPICAL_MIN_SCORE = 0.70
VECTOR_MIN_TEMP = 22
VECTOR_MIN_HUMIDITY = 70
VECTOR_MIN_SCORE = 0.65
PREDICTION_YEAR = 2024

CLIMATE_COLUMNS = [
    "department", "thermal_floor", "avg_temp_c", "precipitation_mm",
    "humidity_pct", "tropical_score",
]
CLIMATE_PROFILES = [
    ("AMAZONAS", "calido", 26.5, 3200.0, 88.0, 1.0),
    ("ANTIOQUIA", "mixto", 23.0, 2400.0, 80.0, 0.75),
    ("ARAUCA", "calido", 27.0, 2200.0, 78.0, 0.95),
    ("ATLANTICO", "calido", 28.0, 900.0, 77.0, 0.9),
    ("BOLIVAR", "calido", 28.0, 1200.0, 82.0, 0.95),
    ("BOYACA", "frio", 16.0, 1100.0, 70.0, 0.3),
    ("CALDAS", "templado", 21.0, 2300.0, 80.0, 0.65),
    ("CAQUETA", "calido", 26.0, 3000.0, 86.0, 1.0),
    ("CASANARE", "calido", 27.0, 2500.0, 80.0, 0.95),
    ("CAUCA", "mixto", 21.0, 1900.0, 78.0, 0.65),
    ("CESAR", "calido", 29.0, 1100.0, 75.0, 0.9),
    ("CHOCO", "calido", 27.0, 8000.0, 90.0, 1.0),
    ("CORDOBA", "calido", 28.0, 1400.0, 81.0, 0.95),
    ("CUNDINAMARCA", "mixto", 19.0, 1200.0, 72.0, 0.5),
    ("GUAINIA", "calido", 27.0, 3000.0, 87.0, 1.0),
    ("GUAVIARE", "calido", 26.5, 2800.0, 85.0, 1.0),
    ("HUILA", "calido", 25.0, 1300.0, 70.0, 0.8),
    ("LA GUAJIRA", "calido", 29.5, 500.0, 65.0, 0.75),
    ("MAGDALENA", "calido", 28.5, 1000.0, 76.0, 0.9),
    ("META", "calido", 26.0, 3200.0, 82.0, 1.0),
    ("NARIÑO", "mixto", 18.0, 2200.0, 81.0, 0.55),
    ("NORTE SANTANDER", "calido", 24.5, 1300.0, 72.0, 0.75),
    ("PUTUMAYO", "calido", 25.0, 3500.0, 86.0, 1.0),
    ("QUINDIO", "templado", 21.0, 2200.0, 80.0, 0.65),
    ("RISARALDA", "templado", 21.0, 2600.0, 83.0, 0.7),
    ("SAN ANDRES", "insular_calido", 27.5, 1900.0, 82.0, 0.95),
    ("SANTANDER", "calido", 24.0, 1900.0, 74.0, 0.8),
    ("SUCRE", "calido", 28.5, 1100.0, 79.0, 0.9),
    ("TOLIMA", "calido", 26.0, 1400.0, 70.0, 0.8),
    ("VALLE", "calido", 24.0, 1600.0, 78.0, 0.85),
    ("VAUPES", "calido", 26.5, 3100.0, 88.0, 1.0),
    ("VICHADA", "calido", 27.0, 2400.0, 80.0, 0.95),
    ("BOGOTA", "frio", 14.0, 1000.0, 75.0, 0.2),
    ("BOGOTA D.C.", "frio", 14.0, 1000.0, 75.0, 0.2),
]
DEFAULT_CLIMATE = ("mixto", 24.0, 1600.0, 76.0, 0.7)

# --- Fixed values: model features -------------------------------------------
TARGET = "total_cases"
CATEGORICAL_FEATURES = [
    "disease", "department", "municipality", "thermal_floor",
    "is_tropical_climate", "is_vector_favorable",
]
NUMERIC_FEATURES = [
    "year", "month", "quarter", "semester", "month_sin", "month_cos",
    "is_rainy_season", "is_high_transmission_month", "avg_temp_c",
    "precipitation_mm", "humidity_pct", "tropical_score",
    "climate_risk_score", "cases_previous_month",
    "cases_previous_2_month_mean", "cases_previous_3_month_mean",
    "cases_previous_6_month_mean", "cases_previous_3_month_sum",
    "cases_previous_6_month_sum", "cases_trend_1m", "cases_trend_3m",
    "department_global_mean_cases", "municipality_global_mean_cases",
    "department_month_mean_cases", "municipality_month_mean_cases",
    "department_disease_mean_cases", "municipality_disease_mean_cases",
    "department_disease_month_mean_cases",
    "municipality_disease_month_mean_cases", "disease_month_mean_cases",
    "national_month_mean_cases", "municipality_share_in_department_month",
]

# --- Fixed values: forest candidates ----------------------------------------
# name, target transform, trees, depth, feature share, row share
FOREST_CANDIDATES = [
    ("rf_accuracy_sqrt_350", "sqrt", 350, 22, 0.80, 0.98),
    ("rf_accuracy_sqrt_500", "sqrt", 500, 26, 0.85, 1.0),
    ("rf_accuracy_log_500", "log1p", 500, 26, 0.85, 1.0),
    ("rf_high_accuracy_sqrt_700", "sqrt", 700, 30, 0.90, 1.0),
]

# --- Fixed values: blend presets --------------------------------------------
BLENDS = {
    "pure_model": {"model": 1.0},
    "model_plus_municipality_month": {
        "model": 0.60,
        "municipality_disease_month_mean_cases": 0.25,
        "municipality_month_mean_cases": 0.15,
    },
    "model_plus_local_history": {
        "model": 0.50,
        "municipality_disease_month_mean_cases": 0.25,
        "municipality_disease_mean_cases": 0.15,
        "cases_previous_3_month_mean": 0.10,
    },
    "model_plus_strong_local_prior": {
        "model": 0.42,
        "municipality_disease_month_mean_cases": 0.35,
        "municipality_disease_mean_cases": 0.13,
        "department_disease_month_mean_cases": 0.10,
    },
}

# --- Fixed values: training rules -------------------------------------------
SEED = 42
MIN_TRAINING_ROWS = 10
MIN_DISEASE_ROWS = 120
SMALL_PANEL_ROWS = 60
TEST_SHARE = 0.20
TEST_SHARE_SMALL = 0.30
TARGET_BINS = 5
SELECTION_WEIGHTS = {"wape_pct": 1.0, "smape_pct": 0.20, "rmse": 0.02, "r2": -8.0}
GLOBAL_MODEL = "GLOBAL"

# --- Fixed values: published prediction record ------------------------------
PREDICTION_KEY = ["disease", "month", "department", "city"]
PREDICTION_COLUMNS = [
    "disease", "month", "department", "city", "estimated_cases",
    "estimated_outbreak_proxy", "outbreak_level", "model_used",
    "thermal_floor", "avg_temp_c", "precipitation_mm", "humidity_pct",
    "tropical_score", "climate_risk_score", "is_rainy_season",
    "is_vector_favorable", "cases_previous_month",
    "cases_previous_2_month_mean", "cases_previous_3_month_mean",
    "validation_r2", "validation_mae", "validation_wape_pct",
]
