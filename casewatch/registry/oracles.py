"""The queries' SQL counterparts, for an independent engine on the same tables."""

from __future__ import annotations

from casewatch import presets

CASES = """
cases AS (
  SELECT CASE WHEN l.l_linenumber = 7 THEN NULL
              ELSE concat(CAST(l.l_orderkey AS VARCHAR), '-', CAST(l.l_linenumber AS VARCHAR))
         END AS CONSECUTIVE,
         210 AS COD_EVE,
         c.c_mktsegment AS enfermedad,
         l.l_shipdate AS FEC_NOT, o.o_orderdate AS INI_SIN,
         CAST(extract(week FROM l.l_shipdate) AS INT) AS SEMANA,
         CAST(extract(isoyear FROM l.l_shipdate) AS INT) AS ANO,
         CAST(l.l_quantity AS INT) AS EDAD,
         CAST(l.l_linenumber % 5 AS INT) AS UNI_MED,
         CASE l.l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'M' ELSE 'SIN_DATO' END AS SEXO,
         CASE l.l_linenumber % 4 WHEN 0 THEN 'C' WHEN 1 THEN 's ' WHEN 2 THEN 'X' END AS TIP_SS,
         CAST(l.l_suppkey % 6 AS INT) AS TIP_CAS,
         CASE l.l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS PAC_HOS,
         CASE o.o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 END AS CON_FIN,
         CAST(n.n_nationkey % 4 AS INT) AS AREA,
         CAST(c.c_custkey % 9 AS INT) AS estrato,
         CASE WHEN l.l_partkey % 50 = 0 THEN 'SIN_DATO' ELSE r.r_name END
           AS Departamento_ocurrencia,
         n.n_name AS Municipio_ocurrencia,
         CAST(r.r_regionkey AS VARCHAR) AS COD_DPTO_O,
         CAST(n.n_nationkey AS VARCHAR) AS COD_MUN_O,
         CASE WHEN l.l_discount > 0.085 THEN 'Confirmado por laboratorio'
              ELSE 'Descartado' END AS nom_est_f_caso
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

AGE_GROUP = """CASE WHEN edad_anos <= 4 THEN '0-4' WHEN edad_anos <= 14 THEN '5-14'
    WHEN edad_anos <= 29 THEN '15-29' WHEN edad_anos <= 44 THEN '30-44'
    WHEN edad_anos <= 59 THEN '45-59' WHEN edad_anos IS NOT NULL THEN '60+'
    ELSE 'Sin dato' END"""

DECODED = CASES + f""",
aged AS (
  SELECT *,
    CASE PAC_HOS WHEN 1 THEN 'Hospitalizado' WHEN 2 THEN 'No hospitalizado'
         ELSE 'Sin dato' END AS hospitalizado,
    CASE CON_FIN WHEN 1 THEN 'Vivo' WHEN 2 THEN 'Muerto' ELSE 'Sin dato' END
      AS condicion_final,
    round_even(CASE UNI_MED WHEN 2 THEN EDAD::DOUBLE / 12.0 WHEN 3 THEN EDAD::DOUBLE / 365.0
         WHEN 4 THEN EDAD::DOUBLE / 8760.0 ELSE EDAD::DOUBLE END * 100, 0) / 100 AS edad_anos,
    CASE WHEN upper(nom_est_f_caso) LIKE '%CONFIRMADO%' OR TIP_CAS IN (3, 4)
         THEN 1 ELSE 0 END AS confirmados
  FROM cases
),
decoded AS (SELECT *, {AGE_GROUP} AS grupo_etario FROM aged)"""

WEEKLY = DECODED + """,
weekly AS (
  SELECT enfermedad, ANO AS "año", SEMANA, Departamento_ocurrencia AS departamento,
         CAST(count(*) AS BIGINT) AS total_casos,
         CAST(sum(confirmados) AS BIGINT) AS confirmados,
         CAST(count(*) FILTER (hospitalizado = 'Hospitalizado') AS BIGINT) AS hospitalizados,
         CAST(count(*) FILTER (condicion_final = 'Muerto') AS BIGINT) AS fallecidos,
         round_even(CAST(sum(CAST(round_even(edad_anos * 100, 0) AS BIGINT)) AS DOUBLE)
                    / count(edad_anos), 0) / 100 AS edad_promedio,
         round_even(CAST(count(*) FILTER (SEXO = 'F') * 10000 AS DOUBLE) / count(*), 0) / 100
           AS pct_femenino,
         min(COD_DPTO_O) AS cod_dpto,
         CAST(month(CAST(date_trunc('week', make_date(ANO, 1, 4)) AS DATE) + (SEMANA - 1) * 7)
              AS INT) AS month,
         CASE WHEN count(*) <= 5 THEN 'bajo' WHEN count(*) <= 10 THEN 'medio' ELSE 'alto' END
           AS risk_label
  FROM decoded WHERE Departamento_ocurrencia <> 'SIN_DATO'
  GROUP BY enfermedad, ANO, SEMANA, Departamento_ocurrencia
)"""


def title(column: str) -> str:
    """Capitalise each run of letters or digits."""
    runs = f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || w[2:]), '')"


def name_key(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL OR trim({column}) = '' THEN 'SIN_DATO' ELSE "
        f"trim(regexp_replace(upper(strip_accents({column})), '\\s+', ' ', 'g')) END"
    )


def alerts_sql(
    source: str, place: str, where: str, keep: float, medium: float, high: float,
    last: int, digits: int = 2, week: str = "SEMANA", count: str = "count(*)",
    show: str = "place", limit: int | None = 20,
) -> str:
    scale = 10**digits
    tail = f" ORDER BY ratio DESC, departamento, semana LIMIT {limit}" if limit else ""
    return f"""{source},
wk AS (SELECT {place} AS place, {week} AS semana, CAST({count} AS BIGINT) AS n
       FROM {where} GROUP BY {place}, {week}),
st AS (SELECT *, avg(n) OVER (PARTITION BY place) AS usual FROM wk)
SELECT {show} AS departamento, semana, n AS casos_semana,
       floor(usual * {scale} + 0.5) / {scale} AS promedio_historico,
       floor(n / usual * 100 + 0.5) / 100 AS ratio,
       CASE WHEN n >= usual * {high} THEN 'ALTO' WHEN n >= usual * {medium} THEN 'MEDIO'
            ELSE 'BAJO' END AS nivel_alerta
FROM st WHERE n >= usual * {keep}
  AND semana >= (SELECT max(semana) FROM wk) - {last - 1}{tail}"""


BUILDING = "cases WHERE upper(enfermedad) = 'BUILDING'"
RECENT = alerts_sql(
    "WITH " + CASES, "Municipio_ocurrencia", BUILDING, 1.2, 1.5, 2.0, 5
)
MEAN_AGE = (
    "floor(CAST(sum(CAST(round_even(edad_anos * 100, 0) AS BIGINT)) AS DOUBLE)"
    " / (count(edad_anos) * {cut}) + 0.5) / {scale}"
)
AGE_2, AGE_1 = MEAN_AGE.format(cut=1, scale=100), MEAN_AGE.format(cut=10, scale=10)
HOSPITALISED = "CAST(count(*) FILTER (hospitalizado = 'Hospitalizado') AS BIGINT)"
DEATHS = "CAST(count(*) FILTER (condicion_final = 'Muerto') AS BIGINT)"
N = "CAST(count(*) AS BIGINT)"


def share(digits: int, over: str = "") -> str:
    scale = 10**digits
    return (
        f"floor(CAST(count(*) * 100 AS DOUBLE) / CAST(sum(count(*)) OVER ({over}) AS DOUBLE)"
        f" * {scale} + 0.5) / {scale}"
    )


ORACLES: dict[str, str] = {}

# --- alerts and dashboard ------------------------------------------------------------

ORACLES["alerts_recent_weeks"] = RECENT
def yearly_alerts_sql(
    source: str, place: str, where: str, keep: float, medium: float, high: float, last: int,
    digits: int = 2, year: str = "ANO", count: str = "count(*)", show: str = "place",
    limit: int | None = 20,
) -> str:
    """As ``alerts_sql`` with weeks of different years apart."""
    scale = 10**digits
    tail = f" ORDER BY ratio DESC, departamento, semana LIMIT {limit}" if limit else ""
    return f"""{source},
wk AS (SELECT {place} AS place, {year}, SEMANA, CAST({count} AS BIGINT) AS n,
         date_diff('day', DATE '1970-01-05', CAST(date_trunc('week', make_date({year}, 1, 4)) AS DATE)
              + (SEMANA - 1) * 7) // 7 AS idx
       FROM {where} GROUP BY {place}, {year}, SEMANA),
st AS (SELECT *, avg(n) OVER (PARTITION BY place) AS usual FROM wk)
SELECT {show} AS departamento, {year}, SEMANA AS semana, n AS casos_semana,
       floor(usual * {scale} + 0.5) / {scale} AS promedio_historico,
       floor(n / usual * 100 + 0.5) / 100 AS ratio,
       CASE WHEN n >= usual * {high} THEN 'ALTO' WHEN n >= usual * {medium} THEN 'MEDIO'
            ELSE 'BAJO' END AS nivel_alerta
FROM st WHERE n >= usual * {keep} AND idx >= (SELECT max(idx) FROM wk) - {last - 1}{tail}"""


SECTOR = "concat(Municipio_ocurrencia, ' ', SEXO)"
ORACLES["alerts_by_year"] = yearly_alerts_sql(
    "WITH " + CASES, "Municipio_ocurrencia", BUILDING, 1.2, 1.5, 2.0, 5
)
ORACLES["alerts_latest_week"] = yearly_alerts_sql(
    "WITH " + CASES, SECTOR, "cases WHERE upper(enfermedad) = 'AUTOMOBILE'", 1.2, 1.5, 2.0, 1,
    show=title("place"), limit=None,
)
PUBLISHED = yearly_alerts_sql(
    "WITH " + CASES, SECTOR, "cases WHERE upper(enfermedad) = 'HOUSEHOLD'", 2.0, 2.0, 3.0, 5, digits=1
)
ORACLES["alerts_published_recent"] = PUBLISHED
ORACLES["alerts_weekly_table"] = yearly_alerts_sql(
    "WITH " + WEEKLY, "departamento", "weekly WHERE upper(enfermedad) = 'AUTOMOBILE'",
    1.2, 1.5, 2.0, 5, year='"año"', count="sum(total_casos)",
)
ORACLES["alert_severity_rollup"] = f"""WITH found AS ({RECENT}),
ranked AS (SELECT *, list_position(['NINGUNO', 'BAJO', 'MEDIO', 'ALTO'], nivel_alerta) AS k
           FROM found)
SELECT ['NINGUNO', 'BAJO', 'MEDIO', 'ALTO'][coalesce(max(k), 1)] AS nivel_global,
       CAST(count(*) AS BIGINT) AS alertas, 'all' AS scope FROM ranked
UNION ALL
SELECT ['NINGUNO', 'BAJO', 'MEDIO', 'ALTO'][coalesce(max(k), 1)],
       CAST(count(*) AS BIGINT), 'nation_12' FROM ranked WHERE upper(departamento) = 'NATION_12'"""
ORACLES["departments_at_risk"] = f"""WITH found AS ({ORACLES['alerts_latest_week']})
SELECT departamento, ratio FROM found WHERE nivel_alerta = 'ALTO'
ORDER BY ratio DESC, departamento, semana LIMIT 5"""
ORACLES["disease_summary"] = f"""WITH {DECODED}
SELECT {title('enfermedad')} AS enfermedad, total_casos, hospitalizados, edad_promedio,
       pct_femenino,
       CAST(floor(CAST(hospitalizados * 100 AS DOUBLE) / total_casos + 0.5) AS INT)
         AS pct_hospitalizados
FROM (SELECT enfermedad, {N} AS total_casos, {HOSPITALISED} AS hospitalizados,
             {AGE_2} AS edad_promedio,
             floor(CAST(count(*) FILTER (SEXO = 'F') AS DOUBLE) * 100.0 / count(*) * 100 + 0.5)
               / 100 AS pct_femenino
      FROM decoded GROUP BY enfermedad)"""
ORACLES["disease_summary_truncated"] = f"""WITH {DECODED}
SELECT enfermedad, {N} AS total_casos, {HOSPITALISED} AS hospitalizados,
       {DEATHS} AS fallecidos, {AGE_1} AS edad_promedio,
       CAST(count(*) FILTER (SEXO = 'F') * 100 // count(*) AS BIGINT) AS pct_femenino
FROM decoded GROUP BY enfermedad"""
ORACLES["peak_week"] = f"""WITH {WEEKLY}
SELECT SEMANA AS semana_pico, CAST(sum(total_casos) AS BIGINT) AS casos_pico
FROM weekly WHERE upper(enfermedad) = 'BUILDING'
GROUP BY SEMANA ORDER BY casos_pico DESC, semana_pico LIMIT 1"""
ORACLES["peak_week_by_year"] = f"""WITH {CASES}
SELECT ANO, SEMANA AS semana_pico, {N} AS casos_pico
FROM {BUILDING} GROUP BY ANO, SEMANA ORDER BY casos_pico DESC, semana_pico, ANO LIMIT 1"""
ORACLES["weekly_series"] = f"""WITH {DECODED}
SELECT SEMANA AS semana, {N} AS casos, {HOSPITALISED} AS hospitalizados
FROM decoded WHERE upper(enfermedad) = 'BUILDING' AND upper(Departamento_ocurrencia) = 'ASIA'
GROUP BY SEMANA"""
BY_PLACE = f"""SELECT {title('enfermedad')} AS enfermedad, {title('departamento')} AS departamento,
       SEMANA AS semana, casos, hospitalizados
FROM (SELECT enfermedad, departamento, SEMANA, CAST(sum(total_casos) AS BIGINT) AS casos,
             CAST(sum(hospitalizados) AS BIGINT) AS hospitalizados
      FROM weekly GROUP BY enfermedad, departamento, SEMANA)"""
ORACLES["weekly_by_place"] = f"WITH {WEEKLY} {BY_PLACE}"
ORACLES["paged_series"] = (
    f"WITH {WEEKLY} {BY_PLACE} ORDER BY enfermedad, departamento, semana LIMIT 50 OFFSET 100"
)
ORACLES["sum_by_key"] = f"""WITH {WEEKLY}
SELECT coalesce(nullif(departamento, 'ASIA'), 'Sin dato') AS departamento,
       CAST(sum(total_casos) AS BIGINT) AS total_casos,
       CAST(sum(hospitalizados) AS BIGINT) AS hospitalizados
FROM weekly GROUP BY 1"""
ORACLES["department_ranking"] = f"""WITH {DECODED}
SELECT Departamento_ocurrencia AS departamento, {N} AS casos, {HOSPITALISED} AS hospitalizados,
       {DEATHS} AS fallecidos, {share(2)} AS pct_nacional
FROM decoded WHERE upper(enfermedad) = 'BUILDING' GROUP BY Departamento_ocurrencia
ORDER BY casos DESC, departamento LIMIT 4"""
ORACLES["department_cases"] = f"""WITH {WEEKLY}
SELECT {title('enfermedad')} AS enfermedad, {title('departamento')} AS departamento, casos
FROM (SELECT enfermedad, departamento, CAST(sum(total_casos) AS BIGINT) AS casos
      FROM weekly GROUP BY enfermedad, departamento)"""
ORACLES["municipality_ranking"] = f"""WITH {CASES}
SELECT Municipio_ocurrencia AS municipio, COD_MUN_O AS cod_dane, {N} AS casos
FROM {BUILDING} AND upper(Departamento_ocurrencia) = 'ASIA'
GROUP BY 1, 2 ORDER BY casos DESC, municipio, cod_dane LIMIT 15"""
ORACLES["municipality_cases"] = f"""WITH {CASES}
SELECT {title('enfermedad')} AS enfermedad, {title('d')} AS departamento,
       {title('m')} AS municipio, casos
FROM (SELECT enfermedad, Departamento_ocurrencia AS d, Municipio_ocurrencia AS m, {N} AS casos
      FROM cases WHERE Municipio_ocurrencia <> 'SIN_DATO' GROUP BY 1, 2, 3)"""
ORACLES["department_totals"] = f"""WITH {DECODED}
SELECT Departamento_ocurrencia AS departamento, {N} AS total_casos,
       {HOSPITALISED} AS hospitalizados, {AGE_1} AS edad_promedio
FROM decoded WHERE upper(enfermedad) = 'BUILDING' GROUP BY 1"""
ORACLES["age_distribution"] = f"""WITH {DECODED}
SELECT grupo_etario, {N} AS casos, min(edad_anos) AS edad_min, {share(1)} AS porcentaje,
       CAST(coalesce(list_position(['0-4', '5-14', '15-29', '30-44', '45-59', '60+',
            'Sin dato'], grupo_etario) - 1, 99) AS INT) AS orden
FROM decoded WHERE upper(enfermedad) = 'BUILDING' AND Departamento_ocurrencia = 'ASIA'
GROUP BY grupo_etario"""
ORACLES["age_by_place"] = f"""WITH {DECODED}
SELECT {title('enfermedad')} AS enfermedad, {title('d')} AS departamento, grupo_etario, casos
FROM (SELECT enfermedad, Departamento_ocurrencia AS d, grupo_etario, {N} AS casos
      FROM decoded GROUP BY 1, 2, 3)"""
ORACLES["sex_distribution"] = f"""WITH {DECODED}
SELECT SEXO AS sexo, {N} AS casos, {share(1)} AS porcentaje
FROM decoded WHERE upper(enfermedad) = 'BUILDING' AND SEXO IN ('M', 'F') GROUP BY SEXO"""
ORACLES["sex_by_place"] = f"""WITH {CASES}
SELECT {title('enfermedad')} AS enfermedad, {title('d')} AS departamento, sexo, casos, porcentaje
FROM (SELECT enfermedad, Departamento_ocurrencia AS d, SEXO AS sexo, {N} AS casos,
             {share(2, 'PARTITION BY enfermedad, Departamento_ocurrencia')} AS porcentaje
      FROM cases WHERE SEXO IN ('M', 'F')
      GROUP BY enfermedad, Departamento_ocurrencia, SEXO)"""
ORACLES["disease_counts"] = f"WITH {CASES} SELECT enfermedad, {N} AS casos FROM cases GROUP BY 1"
ORACLES["health_count"] = f"WITH {CASES} SELECT {N} AS total_casos_db FROM cases"
WORDS = (
    "array_to_string(list_transform(string_split({c}, ' '),"
    " lambda w: upper(w[1]) || lower(w[2:])), ' ')"
)
ORACLES["picker_lists"] = f"""WITH {CASES}
SELECT DISTINCT {WORDS.format(c='Departamento_ocurrencia')} AS label,
       Departamento_ocurrencia AS value, 'department' AS list
FROM {BUILDING}
UNION ALL
SELECT DISTINCT {WORDS.format(c='Municipio_ocurrencia')}, Municipio_ocurrencia, 'city'
FROM cases WHERE Departamento_ocurrencia = 'ASIA'"""
ORACLES["filtered_cases"] = f"""WITH {CASES}
SELECT CONSECUTIVE, SEMANA, ANO, Municipio_ocurrencia, SEXO
FROM {BUILDING} AND Departamento_ocurrencia = 'ASIA' AND SEXO IN ('M', 'F')
  AND Municipio_ocurrencia <> 'SIN_DATO'"""

# --- cleaning ----------------------------------------------------------------------------

ORACLES["clean_cases"] = f"""WITH {DECODED}
SELECT CONSECUTIVE, CAST(COD_EVE AS INT) AS COD_EVE, CAST(NULL AS VARCHAR) AS Nombre_evento,
  FEC_NOT, CASE WHEN SEMANA BETWEEN 1 AND 53 THEN SEMANA END AS SEMANA,
  CASE WHEN ANO BETWEEN 2000 AND 2100 THEN ANO END AS ANO, INI_SIN, EDAD, UNI_MED,
  coalesce(CASE WHEN SEXO IN ('M', 'F') THEN SEXO END, 'SIN_DATO') AS SEXO,
  CASE WHEN estrato BETWEEN 0 AND 6 THEN estrato END AS estrato,
  upper(trim(TIP_SS)) AS TIP_SS, TIP_CAS, PAC_HOS, CON_FIN, CAST(NULL AS INT) AS GP_GESTAN,
  AREA, lpad(COD_DPTO_O, 2, '0') AS COD_DPTO_O, lpad(COD_MUN_O, 5, '0') AS COD_MUN_O,
  Departamento_ocurrencia, Municipio_ocurrencia,
  'SIN_DATO' AS Departamento_residencia, 'SIN_DATO' AS Municipio_residencia,
  upper(nom_est_f_caso) AS nom_est_f_caso, CAST(confirmados AS INT) AS confirmados,
  enfermedad, 'STAR' AS source_name, 'LINEITEM.PARQUET' AS source_file, edad_anos,
  grupo_etario,
  CASE TIP_CAS WHEN 1 THEN 'Sospechoso' WHEN 2 THEN 'Probable' WHEN 3 THEN 'Confirmado_Lab'
    WHEN 4 THEN 'Confirmado_Clinico' ELSE 'Sin dato' END AS tipo_caso,
  condicion_final, hospitalizado,
  CASE AREA WHEN 1 THEN 'Cabecera municipal' WHEN 2 THEN 'Rural disperso'
    WHEN 3 THEN 'Centro poblado' ELSE 'Sin dato' END AS area_residencia,
  CASE UNI_MED WHEN 1 THEN 'Años' WHEN 2 THEN 'Meses' WHEN 3 THEN 'Días' WHEN 4 THEN 'Horas'
    ELSE 'Sin dato' END AS unidad_edad,
  coalesce(CASE TIP_SS WHEN 'C' THEN 'Contributivo' WHEN 's ' THEN 'Subsidiado' END,
           TIP_SS, 'Sin dato') AS regimen_salud,
  CASE WHEN d BETWEEN 0 AND 365 THEN CAST(d AS INT) END AS dias_notificacion
FROM (SELECT *, CAST(floor((epoch_us(FEC_NOT) - epoch_us(INI_SIN)) / 86400000000.0) AS BIGINT)
        AS d FROM decoded)"""
MISSING = ", ".join(f"'{t}'" for t in presets.MISSING_TOKENS)
ORACLES["text_normalize"] = f"""
WITH t AS (SELECT doc_id, source,
  trim(regexp_replace(upper(replace(strip_accents(text), 'ß', 'ss')), '\\s+', ' ', 'g'))
    AS normal FROM documents)
SELECT doc_id, CASE WHEN normal NOT IN ({MISSING}) THEN normal END AS normal,
       {name_key('source')} AS source_key FROM t"""
ORACLES["title_case"] = f"""
WITH t AS (SELECT n_nationkey, n_name || ' d.c.-o''x' AS name FROM nation)
SELECT n_nationkey, {title('name')} AS words,
       {WORDS.format(c='name')} AS blanks, upper(name) AS key FROM t"""
ORACLES["disease_names"] = f"""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Dengue' WHEN 1 THEN 'Chikungunya'
  WHEN 2 THEN 'Malaria' WHEN 3 THEN 'Malaria' ELSE {title('c_mktsegment')} END AS disease
FROM customer"""
ORACLES["code_normalize"] = """
WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1, 2, 5)
                                  THEN CAST(p_partkey AS VARCHAR) END AS k FROM part)
SELECT p_partkey, lpad(k, CAST(greatest(length(k), 2) AS INT), '0') AS code_2,
       lpad(k, CAST(greatest(length(k), 5) AS INT), '0') AS code_5 FROM d"""
ORACLES["number_parse"] = """
WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size + 0.5
  WHEN 3 THEN -p_size WHEN 4 THEN 100 WHEN 5 THEN p_size END::DOUBLE AS number FROM part)
SELECT p_partkey, CAST(round_even(number, 0) AS INT) AS whole, number FROM v"""
ORACLES["date_parse_two_pass"] = """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') ELSE 'sin fecha' END AS shown
  FROM orders)
SELECT o_orderkey, CAST(coalesce(try_strptime(shown, ['%Y-%m-%d', '%m/%d/%Y',
    '%Y/%m/%d %H:%M:%S']), try_strptime(shown, '%d/%m/%Y')) AS TIMESTAMP) AS parsed FROM t"""
MONDAY = "CAST(date_trunc('week', make_date(ANO, 1, {d})) AS DATE) + (SEMANA - 1 + {k}) * 7"
ORACLES["week_calendar"] = f"""WITH {CASES},
w AS (SELECT ANO, SEMANA, {N} AS n FROM cases GROUP BY 1, 2)
SELECT ANO, SEMANA, n, CAST(month({MONDAY.format(d=4, k=0)}) AS INT) AS month,
  CASE WHEN SEMANA + 1 <= extract(week FROM make_date(ANO, 12, 28))
       THEN CAST(month({MONDAY.format(d=4, k=1)}) AS INT) END AS next_month,
  CAST({MONDAY.format(d=7, k=0)} AS DATE) AS monday FROM w"""
ORACLES["finite_values"] = """
SELECT p_partkey, CASE WHEN p_partkey % 4 >= 2 THEN p_retailprice END AS price FROM part"""
COLUMNS = (
    "CONSECUTIVE, COD_EVE, enfermedad, FEC_NOT, INI_SIN, SEMANA, ANO, EDAD, UNI_MED, SEXO, "
    "TIP_SS, TIP_CAS, PAC_HOS, CON_FIN, AREA, estrato, Departamento_ocurrencia, "
    "Municipio_ocurrencia, COD_DPTO_O, COD_MUN_O, nom_est_f_caso"
)
PLACED = CASES.replace(
    "AS nom_est_f_caso\n", "AS nom_est_f_caso, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity\n", 1
)
ORDERED = "l_orderkey * 8 + l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)"
DEDUPED = PLACED + f""",
with_id AS (
  SELECT {COLUMNS}, CAST(count(*) OVER (PARTITION BY enfermedad, CONSECUTIVE, COD_EVE) AS BIGINT)
           AS copies,
         row_number() OVER (PARTITION BY enfermedad, CONSECUTIVE, COD_EVE ORDER BY {ORDERED}) AS rn
  FROM cases WHERE CONSECUTIVE IS NOT NULL AND CONSECUTIVE <> 'SIN_DATO'
),
deduped AS (
  SELECT {COLUMNS}, copies FROM with_id WHERE rn = 1
  UNION ALL
  SELECT {COLUMNS}, CAST(count(*) AS BIGINT) FROM cases
  WHERE CONSECUTIVE IS NULL OR CONSECUTIVE = 'SIN_DATO' GROUP BY {COLUMNS}
)"""
ORACLES["dedupe_cases"] = f"WITH {DEDUPED} SELECT * FROM deduped"
ORACLES["dedupe_removed"] = f"""WITH {DEDUPED}
SELECT CAST(sum(copies) AS BIGINT) AS rows_before, CAST(count(*) AS BIGINT) AS rows_after,
       CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed FROM deduped"""
KEYED = CASES.replace("AS nom_est_f_caso\n", "AS nom_est_f_caso, l.l_partkey, l.l_suppkey\n", 1)
ORACLES["reject_split"] = f"""WITH {KEYED},
v AS (SELECT * REPLACE (CASE WHEN l_partkey % 11 <> 0 THEN enfermedad END AS enfermedad,
        CASE WHEN l_partkey % 13 <> 0 THEN SEMANA END AS SEMANA, CASE WHEN l_suppkey % 7 <> 0 THEN ANO END AS ANO)
      FROM cases)
SELECT enfermedad, ANO, SEMANA, Departamento_ocurrencia, Municipio_ocurrencia, {N} AS n,
       concat_ws('|', CASE WHEN ANO IS NULL THEN 'year' END, CASE WHEN SEMANA IS NULL THEN 'week' END,
         CASE WHEN enfermedad IS NULL THEN 'disease' END,
         CASE WHEN Departamento_ocurrencia = 'SIN_DATO' THEN 'department' END) AS reason
FROM v GROUP BY ALL"""
RAW = KEYED.replace("cases AS (", "base AS (", 1) + """,
once AS (
  SELECT * EXCLUDE (l_partkey, l_suppkey) REPLACE (
    CONSECUTIVE || '-' || l_partkey || '-' || l_suppkey AS CONSECUTIVE,
    CASE WHEN l_partkey % 97 <> 0 THEN SEMANA END AS SEMANA,
    CASE WHEN l_suppkey % 7 = 0 THEN 1899 ELSE ANO END AS ANO), l_partkey % 10 = 0 AS twice
  FROM base
),
cases AS (SELECT * EXCLUDE (twice) FROM once UNION ALL SELECT * EXCLUDE (twice) FROM once WHERE twice)"""
CLEANED = RAW + ORACLES["clean_cases"].removeprefix("WITH " + CASES).replace(
    "\nSELECT CONSECUTIVE,", ",\ncleaned AS (SELECT CONSECUTIVE,", 1
).replace("CAST(NULL AS VARCHAR) AS Nombre_evento", "enfermedad AS Nombre_evento", 1) + f"""),
kept AS (
  SELECT *, CASE WHEN CONSECUTIVE IS NULL THEN hash(cleaned) END AS content FROM cleaned
  QUALIFY row_number() OVER (PARTITION BY enfermedad, CONSECUTIVE, COD_EVE, content) = 1
),
judged AS (
  SELECT *, concat_ws('|', CASE WHEN ANO IS NULL THEN 'year' END, CASE WHEN SEMANA IS NULL THEN 'week' END,
         CASE WHEN Departamento_ocurrencia = 'SIN_DATO' THEN 'department' END) AS reason FROM kept
),
valid AS (SELECT * FROM judged WHERE reason = '')"""
ETL_WEEKLY = WEEKLY.split("weekly AS (")[1].replace(
    "FROM decoded WHERE Departamento_ocurrencia <> 'SIN_DATO'", "FROM valid", 1
).replace("<= 5 THEN", "<= 50 THEN", 1).replace("<= 10 THEN", "<= 200 THEN", 1)
ORACLES["etl_weekly"] = f"WITH {CLEANED}, weekly AS ({ETL_WEEKLY} SELECT * FROM weekly"
ETL_COLUMNS = [*presets.CANONICAL_COLUMNS, *presets.LINEAGE_COLUMNS, *presets.DERIVED_COLUMNS]
ETL_NULLS = "\n".join(
    f"UNION ALL SELECT 'nulls_{c}', CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) FROM valid" for c in ETL_COLUMNS
)
ORACLES["full_etl"] = f"""WITH {CLEANED},
report AS (
  SELECT 'total_clean_rows' AS metric, {N} AS value FROM valid
  UNION ALL SELECT 'total_rejected_rows', {N} FROM judged WHERE reason <> ''
  UNION ALL SELECT 'duplicates_removed', CAST((SELECT count(*) FROM cleaned) - (SELECT count(*) FROM kept) AS BIGINT)
  UNION ALL SELECT 'rows_disease_' || enfermedad, {N} FROM valid GROUP BY enfermedad
  UNION ALL SELECT 'total_aggregated_rows', {N} FROM (
    SELECT DISTINCT enfermedad, ANO, SEMANA, Departamento_ocurrencia FROM valid)
  {ETL_NULLS}
)
SELECT 'quality.json' AS artefact, metric, value FROM report
UNION ALL SELECT 'quality.csv', metric, value FROM report
UNION ALL SELECT 'rejected.csv', reason, {N} FROM judged WHERE reason <> '' GROUP BY reason
UNION ALL SELECT 'clean_by_disease', lower(enfermedad), {N} FROM valid GROUP BY enfermedad
UNION ALL SELECT 'clean.parquet', enfermedad, {N} FROM valid GROUP BY enfermedad"""
ORACLES["csv_scan"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderkey % 7 <> 2 THEN CAST(o_custkey AS VARCHAR) END AS o_custkey,
  CASE WHEN o_orderkey % 7 <> 2 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 2 THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 7 <> 2 THEN 'Bogotá ' || translate(o_orderpriority, 'EIOU', 'ÉÍÓÜ') END AS place
FROM orders"""
ORACLES["raw_file_check"] = """
WITH p AS (SELECT page_id, page_id % 48 AS kind, CASE page_id % 4 WHEN 0 THEN 'PK' || html
    WHEN 1 THEN repeat('a,b,c' || chr(10), 99) || html ELSE html END AS body FROM pages),
f AS (SELECT kind, arg_min(body, page_id) || chr(10) AS first, CAST(sum(octet_length(encode(body)) + 1) AS BIGINT) AS size_bytes FROM p GROUP BY kind)
SELECT kind || CASE kind % 3 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.csv' ELSE '.json' END AS filename, size_bytes,
  CASE WHEN size_bytes < 100 THEN FALSE WHEN kind % 3 = 0 THEN first LIKE 'PK%'
    WHEN kind % 3 = 1 THEN NOT (lower(substr(first, 1, 500)) LIKE '%<html%' OR lower(substr(first, 1, 500)) LIKE '%<!doctype html%')
    ELSE TRUE END AS is_valid
FROM f"""
SOURCE_FILES = ", ".join(f"({i}, '{row[0]}', '{row[5]}')" for i, row in enumerate(presets.SOURCES))
ORACLES["ingest_manifest"] = f"""
WITH s(kind, disease, filename) AS (VALUES {SOURCE_FILES}),
p AS (SELECT page_id % 5 AS kind, CASE page_id % 5 WHEN 0 THEN repeat('a,b' || chr(10) || '1,2' || chr(10), 200)
        WHEN 1 THEN 'PK' || html ELSE html END AS body FROM pages WHERE page_id % 5 < 4),
f AS (SELECT kind, octet_length(encode(body)) AS size, CASE WHEN octet_length(encode(body)) < 100 THEN FALSE
        WHEN kind IN (1, 3) THEN body LIKE 'PK%' ELSE NOT (lower(substr(body, 1, 500)) LIKE '%<html%'
          OR lower(substr(body, 1, 500)) LIKE '%<!doctype html%') END AS ok FROM p)
SELECT disease, filename, CASE WHEN size IS NULL THEN 'failed_request' WHEN size > 1000 THEN 'cached'
    WHEN NOT ok THEN 'invalid_content' ELSE 'downloaded' END AS status,
  {N} AS n, CAST(sum(coalesce(size, 0)) AS BIGINT) AS size_bytes
FROM s LEFT JOIN f USING (kind) GROUP BY 1, 2, 3"""
NULLS = "\n".join(
    f"UNION ALL SELECT 'nulls_{c}', CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) FROM valid"
    for c in COLUMNS.split(", ")
)
ORACLES["quality_report"] = f"""WITH {DEDUPED},
valid AS (SELECT * FROM deduped WHERE Departamento_ocurrencia <> 'SIN_DATO')
SELECT 'total_clean_rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM valid
UNION ALL SELECT 'total_rejected_rows', CAST(count(*) AS BIGINT) FROM deduped
  WHERE Departamento_ocurrencia = 'SIN_DATO'
{NULLS}
UNION ALL SELECT 'rows_disease_' || enfermedad, CAST(count(*) AS BIGINT) FROM valid
  GROUP BY enfermedad
UNION ALL SELECT 'duplicates_removed', CAST(sum(copies - 1) AS BIGINT) FROM deduped
UNION ALL SELECT 'total_aggregated_rows', CAST(count(*) AS BIGINT) FROM (
  SELECT DISTINCT enfermedad, ANO, SEMANA, Departamento_ocurrencia FROM valid)"""
ORACLES["weekly_aggregate"] = f"WITH {WEEKLY} SELECT * FROM weekly"
ORACLES["round_trip_sinks"] = ORACLES["weekly_aggregate"]
ORACLES["schema_align"] = """
SELECT CAST(c_custkey AS VARCHAR) AS CONSECUTIVE, '210' AS COD_EVE, 'Dengue' AS Nombre_evento,
  CASE WHEN c_custkey % 2 = 0 THEN '2023' ELSE '2022' END AS ANO,
  CAST(c_nationkey AS VARCHAR) AS COD_MUN_O, CAST(NULL AS VARCHAR) AS confirmados,
  'Dengue' AS enfermedad, 'medata' AS source_name, 'customer.parquet' AS source_file
FROM customer
UNION ALL
SELECT CAST(s_suppkey AS VARCHAR), '490', s_name, '2021', CAST(s_nationkey AS VARCHAR), NULL,
  'Malaria', 'medata', 'supplier.parquet' FROM supplier"""

# --- files and sinks -----------------------------------------------------------------------

ORACLES["file_validation"] = """
WITH p AS (SELECT page_id, page_id % 4 AS kind, CASE page_id % 4
    WHEN 0 THEN 'a,b,c' || chr(10) || repeat('1,2,3' || chr(10), 40)
    WHEN 1 THEN 'a,b' || chr(10) || '1,2' || chr(10) WHEN 2 THEN 'PK' || html ELSE html END AS body,
    CAST(page_id AS VARCHAR) || CASE WHEN page_id % 4 < 2 OR page_id % 8 = 3 THEN '.csv'
      ELSE '.xlsx' END AS filename
  FROM pages)
SELECT page_id, filename, CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes,
  CASE WHEN octet_length(encode(body)) < 100 THEN FALSE
       WHEN filename LIKE '%.xlsx' THEN body LIKE 'PK%'
       ELSE NOT (lower(substr(body, 1, 500)) LIKE '%<html%'
                 OR lower(substr(body, 1, 500)) LIKE '%<!doctype html%') END AS is_valid
FROM p"""
PREDICTIONS = CASES + """,
predictions AS (
  SELECT enfermedad AS disease, CAST(month(FEC_NOT) AS INT) AS month,
         Departamento_ocurrencia AS department, Municipio_ocurrencia AS city,
         CAST(count(*) AS INT) AS estimated_cases
  FROM cases GROUP BY ALL
)"""
ORACLES["upsert_predictions"] = f"""WITH {PREDICTIONS}
SELECT disease, month, department, city,
       CAST(estimated_cases + CASE WHEN month >= 5 THEN 1000 ELSE 0 END AS INT) AS estimated_cases
FROM predictions"""
ORACLES["prediction_lookup"] = f"""WITH {PREDICTIONS}
SELECT * FROM predictions WHERE disease = 'BUILDING' AND month = 3 AND department = 'ASIA'
  AND city = 'NATION_2'"""
ORACLES["load_audit"] = f"""WITH {WEEKLY}
SELECT 'surveillance_etl' AS source, (SELECT CAST(count(*) AS BIGINT) FROM cases) AS clean_rows,
       (SELECT CAST(count(*) AS BIGINT) FROM weekly) AS aggregated_rows,
       CAST(0 AS BIGINT) AS prediction_rows"""

# --- panel and priors -------------------------------------------------------------------------

PANEL = CASES + f""",
counts AS (
  SELECT {title('enfermedad')} AS disease, ANO AS year, CAST(month(FEC_NOT) AS INT) AS month,
         Departamento_ocurrencia AS department, Municipio_ocurrencia AS municipality,
         count(*) AS n
  FROM cases
  WHERE Departamento_ocurrencia <> 'SIN_DATO' AND Municipio_ocurrencia <> 'SIN_DATO'
  GROUP BY ALL
),
panel AS (
  SELECT e.disease, e.year, e.department, e.municipality, CAST(m.m AS INT) AS month,
         CAST(coalesce(c.n, 0) AS DOUBLE) AS total_cases
  FROM (SELECT DISTINCT disease, year, department, municipality FROM counts) e
  CROSS JOIN range(1, 13) AS m(m)
  LEFT JOIN counts c ON c.disease = e.disease AND c.year = e.year
    AND c.department = e.department AND c.municipality = e.municipality AND c.month = m.m
)"""
ORACLES["monthly_panel"] = f"WITH {PANEL} SELECT * FROM panel"


def six(expression: str) -> str:
    return f"round_even(({expression}) * 1000000, 0) / 1000000"


def climate_values(compat: bool) -> str:
    rows = ", ".join(
        f"('{name}', '{floor}', {t}::DOUBLE, {p}::DOUBLE, {h}::DOUBLE, {s}::DOUBLE)"
        for name, floor, t, p, h, s in presets.CLIMATE_PROFILES
    )
    key = "place" if compat else "strip_accents(place)"
    return (
        f"(SELECT {key} AS place, thermal_floor, avg_temp_c, precipitation_mm, humidity_pct, "
        f"tropical_score FROM (VALUES {rows}) AS v(place, thermal_floor, avg_temp_c, "
        "precipitation_mm, humidity_pct, tropical_score))"
    )


def with_climate(source: str, compat: bool) -> str:
    floor, t, p, h, s = presets.DEFAULT_CLIMATE
    return f"""SELECT x.*, coalesce(v.thermal_floor, '{floor}') AS thermal_floor,
  coalesce(v.avg_temp_c, {t}) AS avg_temp_c, coalesce(v.precipitation_mm, {p}) AS precipitation_mm,
  coalesce(v.humidity_pct, {h}) AS humidity_pct, coalesce(v.tropical_score, {s}) AS tropical_score
FROM {source} x LEFT JOIN {climate_values(compat)} v ON v.place = strip_accents(x.department)"""


SEASON = f"""
  CAST((month - 1) // 3 + 1 AS INT) AS quarter,
  CAST(CASE WHEN month <= 6 THEN 1 ELSE 2 END AS INT) AS semester,
  CAST(month IN (4, 5, 10, 11) AS INT) AS is_rainy_season,
  CAST(month IN (3, 4, 5, 6, 10, 11) AS INT) AS is_high_transmission_month,
  CASE WHEN tropical_score >= 0.70 THEN 'SI' ELSE 'NO' END AS is_tropical_climate,
  CASE WHEN avg_temp_c >= 22 AND humidity_pct >= 70 AND tropical_score >= 0.65
       THEN 'SI' ELSE 'NO' END AS is_vector_favorable,
  round_even((0.35::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (avg_temp_c - 14) / 16))
    + 0.25::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, precipitation_mm / 3000))
    + 0.20::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, humidity_pct / 100))
    + 0.15::DOUBLE * tropical_score
    + 0.05::DOUBLE * CAST(month IN (4, 5, 10, 11) AS INT)) * 10000, 0) / 10000
    AS climate_risk_score,
  {six('sin(2 * pi() * month / 12)')} AS month_sin,
  {six('cos(2 * pi() * month / 12)')} AS month_cos"""
NAMES = "[" + ", ".join(f"'{row[0]}'" for row in presets.CLIMATE_PROFILES) + "]"
ORACLES["climate_features"] = f"""WITH {PANEL},
months AS (SELECT month, sum(total_cases) AS total_cases FROM panel GROUP BY month),
places AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name
             ELSE {NAMES}[n_nationkey + 9] END AS department FROM nation),
each_month AS (SELECT m.month, p.department, p.n_nationkey, m.total_cases
               FROM places p CROSS JOIN months m),
profiled AS (SELECT *, FALSE AS compat FROM ({with_climate('each_month', False)})
             UNION ALL SELECT *, TRUE FROM ({with_climate('each_month', True)}))
SELECT *, {SEASON} FROM profiled"""
TEMPORAL = PANEL + """,
lagged AS (
  SELECT *,
    coalesce(lag(total_cases, 1) OVER w, 0) AS cases_previous_month,
    coalesce(lag(total_cases, 2) OVER w, 0) AS p2,
    coalesce(avg(total_cases) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0)
      AS cases_previous_2_month_mean,
    coalesce(avg(total_cases) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)
      AS cases_previous_3_month_mean,
    coalesce(avg(total_cases) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0)
      AS cases_previous_6_month_mean,
    coalesce(sum(total_cases) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)
      AS cases_previous_3_month_sum,
    coalesce(sum(total_cases) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0)
      AS cases_previous_6_month_sum
  FROM panel
  WINDOW w AS (PARTITION BY disease, department, municipality ORDER BY year, month)
)"""
ORACLES["temporal_features"] = f"""WITH {TEMPORAL}
SELECT disease, year, department, municipality, month, total_cases, cases_previous_month,
  cases_previous_2_month_mean, {six('cases_previous_3_month_mean')} AS cases_previous_3_month_mean,
  {six('cases_previous_6_month_mean')} AS cases_previous_6_month_mean,
  cases_previous_3_month_sum, cases_previous_6_month_sum,
  cases_previous_month - p2 AS cases_trend_1m,
  {six('cases_previous_3_month_mean - cases_previous_6_month_mean')} AS cases_trend_3m
FROM lagged"""
ORACLES["weekly_lags"] = f"""
WITH e AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS monday, {N} AS n
           FROM events GROUP BY 1, 2)
SELECT event_type, monday, n, lag(n, 1) OVER w AS n_lag_1w, lag(n, 2) OVER w AS n_lag_2w,
  lag(n, 4) OVER w AS n_lag_4w,
  {six('avg(n) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS n_ma4
FROM e WINDOW w AS (PARTITION BY event_type ORDER BY monday)"""

GRAINS = {
    "g_dept": ["department"], "g_muni": ["department", "municipality"],
    "g_dept_m": ["department", "month"], "g_muni_m": ["department", "municipality", "month"],
    "g_dd": ["disease", "department"], "g_dm": ["disease", "department", "municipality"],
    "g_dd_m": ["disease", "department", "month"],
    "g_dm_m": ["disease", "department", "municipality", "month"],
    "g_d_m": ["disease", "month"], "g_m": ["month"],
}
SEEN_GRAINS = (
    ", seen AS (SELECT * FROM panel WHERE disease <> 'Building' AND department <> 'ASIA')"
    + "".join(
        f",\n{name} AS (SELECT {', '.join(keys)}, avg(total_cases) AS v FROM seen GROUP BY ALL)"
        for name, keys in GRAINS.items()
    )
    + ",\ng_all AS (SELECT avg(total_cases) AS v FROM seen)"
)


def prior_select(source: str) -> str:
    joins = "\n".join(
        f"LEFT JOIN {name} ON " + " AND ".join(f"{name}.{k} = x.{k}" for k in keys)
        for name, keys in GRAINS.items()
    )
    return f"""
chain AS (SELECT x.*,
    coalesce(g_dept.v, g_all.v) AS department_global_mean_cases,
    coalesce(g_muni.v, g_dept.v, g_all.v) AS municipality_global_mean_cases,
    coalesce(g_dept_m.v, g_dept.v, g_all.v) AS department_month_mean_cases,
    coalesce(g_muni_m.v, g_muni.v, g_dept.v, g_all.v) AS municipality_month_mean_cases,
    coalesce(g_dd.v, g_dept.v, g_all.v) AS department_disease_mean_cases,
    coalesce(g_dm.v, g_muni.v, g_dept.v, g_all.v) AS municipality_disease_mean_cases,
    coalesce(g_dd_m.v, g_dd.v, g_dept.v, g_all.v) AS department_disease_month_mean_cases,
    coalesce(g_dm_m.v, g_dm.v, g_muni.v, g_dept.v, g_all.v)
      AS municipality_disease_month_mean_cases,
    coalesce(g_d_m.v, g_all.v) AS disease_month_mean_cases,
    coalesce(g_m.v, g_all.v) AS national_month_mean_cases
  FROM {source} x CROSS JOIN g_all
  {joins}),
priors AS (SELECT *, least(greatest(coalesce(municipality_month_mean_cases
    / nullif(department_month_mean_cases, 0), 0), 0), 10) AS municipality_share_in_department_month
  FROM chain)"""


ORACLES["prior_features"] = (
    f"WITH {PANEL}{SEEN_GRAINS},{prior_select('panel')} SELECT * FROM priors"
)


def lags_sql(compat: bool) -> str:
    def month(k: int) -> str:
        if compat:
            return f"CASE WHEN s.month - {k} < 1 THEN 12 ELSE s.month - {k} END"
        return f"((s.month - {k} - 1 + 12) % 12) + 1"

    joins = "\n".join(
        f"LEFT JOIN g_dm_m m{k} ON m{k}.disease = s.disease AND m{k}.department = s.department"
        f" AND m{k}.municipality = s.municipality AND m{k}.month = {month(k)}"
        for k in range(1, 7)
    )
    lags = ", ".join(
        f"coalesce({', '.join(f'm{i}.v' for i in range(k, 0, -1))}, gm.v, g_all.v) AS l{k}"
        for k in range(1, 7)
    )
    return f"""WITH {PANEL}{SEEN_GRAINS},
scaffold AS (SELECT e.*, CAST(m.m AS INT) AS month
  FROM (SELECT DISTINCT disease, department, municipality FROM counts) e
  CROSS JOIN range(1, 13) AS m(m)),
l AS (SELECT s.*, {lags} FROM scaffold s CROSS JOIN g_all
  LEFT JOIN g_muni gm ON gm.department = s.department AND gm.municipality = s.municipality
  {joins})
SELECT disease, department, municipality, month, {six('l1')} AS cases_previous_month,
  {six('(l1 + l2) / 2')} AS cases_previous_2_month_mean,
  {six('l1 + l2 + l3')} AS cases_previous_3_month_sum,
  {six('(l1 + l2 + l3 + l4 + l5 + l6) / 6')} AS cases_previous_6_month_mean,
  {six('l1 - l2')} AS cases_trend_1m FROM l"""


ORACLES["inference_lags"] = lags_sql(False)
ORACLES["inference_lags_compat"] = lags_sql(True)
ORACLES["scoring_inputs"] = f"""WITH {PANEL},
scaffold AS (SELECT e.*, CAST(m.m AS INT) AS month, 2024 AS year
  FROM (SELECT DISTINCT disease, department, municipality FROM counts) e
  CROSS JOIN range(1, 13) AS m(m)),
profiled AS ({with_climate('scaffold', False)})
SELECT *, {SEASON} FROM profiled"""
ORACLES["outbreak_scalars"] = f"""WITH {PANEL},
r AS (SELECT total_cases, {N} AS n FROM panel GROUP BY 1)
SELECT total_cases, n,
  CASE WHEN total_cases < 5 THEN 'Sin brote relevante' WHEN total_cases < 25 THEN 'Brote bajo'
       WHEN total_cases < 75 THEN 'Brote medio' ELSE 'Brote alto' END AS level,
  {six('ln(1 + total_cases)')} AS log_y, {six('sqrt(total_cases)')} AS sqrt_y,
  total_cases AS back_log, total_cases AS back_sqrt,
  {six('1 + ln(1 + total_cases)')} AS weight FROM r"""

# --- modelling ---------------------------------------------------------------------------------


def metric_columns(y: str, p: str) -> str:
    gap = f"abs({y} - {p})"
    middle = f"((abs({y}) + abs({p})) / 2)"

    def four(e: str) -> str:
        return f"round_even(({e}) * 10000, 0) / 10000"

    return f"""{four(f'avg({gap})')} AS mae, {four(f'sqrt(avg({gap} * {gap}))')} AS rmse,
  {four(f'1 - sum({gap} * {gap}) / (var_pop({y}) * count(*))')} AS r2,
  {four(f'coalesce(avg({gap} / nullif({y}, 0)), 0) * 100')} AS mape_non_zero_pct,
  {four(f'coalesce(sum({gap}) / nullif(sum(abs({y})), 0), 0) * 100')} AS wape_pct,
  {four(f'avg({gap} / CASE WHEN {middle} = 0 THEN 1 ELSE {middle} END) * 100')} AS smape_pct"""


ORACLES["regression_metrics"] = f"""WITH {TEMPORAL}
SELECT disease, {metric_columns('total_cases', 'cases_previous_month')}
FROM lagged GROUP BY disease"""
def blended_sql(model: str) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({order} AS INT) AS blend_order, '{name}' AS blend, total_cases AS y, greatest("
        + "("
        + " + ".join(
            f"{model if part == 'model' else part} * {weight}::DOUBLE"
            for part, weight in weights.items()
        )
        + f") / {sum(weights.values())}::DOUBLE, 0) AS p FROM priors"
        for order, (name, weights) in enumerate(presets.BLENDS.items())
    )


BLENDED = blended_sql("cases_previous_month")
ORACLES["blend_select"] = f"""WITH {TEMPORAL}{SEEN_GRAINS},{prior_select('lagged')},
mixed AS ({BLENDED}),
m AS (SELECT blend_order, blend, {metric_columns('y', 'p')} FROM mixed GROUP BY 1, 2)
SELECT *, {six('wape_pct + 0.20 * smape_pct + 0.02 * rmse - 8 * r2')} AS score FROM m"""
ALL_GRAINS = SEEN_GRAINS.replace(" WHERE disease <> 'Building' AND department <> 'ASIA'", "", 1)
ORACLES["prior_features_all"] = f"WITH {PANEL}{ALL_GRAINS},{prior_select('panel')} SELECT * FROM priors"
CANDIDATE_BLENDS = " UNION ALL ".join(
    f"SELECT {i} AS turn, '{name}' AS candidate, * FROM ({blended_sql(name)})"
    for i, name in enumerate(("cases_previous_month", "cases_previous_3_month_mean"))
)
ORACLES["model_selection"] = f"""WITH {TEMPORAL}{ALL_GRAINS},{prior_select('lagged')},
mixed AS ({CANDIDATE_BLENDS}),
m AS (SELECT turn, candidate, blend_order, blend, {metric_columns('y', 'p')} FROM mixed GROUP BY 1, 2, 3, 4)
SELECT candidate, blend, mae, wape_pct, {six('wape_pct + 0.20 * smape_pct + 0.02 * rmse - 8 * r2')} AS score
FROM m ORDER BY wape_pct + 0.20 * smape_pct + 0.02 * rmse - 8 * r2, turn, blend_order LIMIT 1"""
ORACLES["model_routing"] = f"""WITH {PANEL}
SELECT disease, {N} AS training_rows, CASE WHEN count(*) >= 1950 THEN disease ELSE 'GLOBAL' END AS model_used
FROM panel WHERE total_cases > 1 GROUP BY disease"""
ORACLES["category_index"] = " UNION ALL ".join([*(
    f"""SELECT '{c}' AS "column", {c} AS value, first_value({c}) OVER (ORDER BY n DESC, {c}) AS mode, CAST(NULL AS DOUBLE) AS median,
  CAST(row_number() OVER (ORDER BY n DESC, {c}) - 1 AS INT) AS number,
  CAST(row_number() OVER (ORDER BY n DESC, {c}) - 1 AS INT) AS hot, CAST(count(*) OVER () AS INT) AS width
FROM (WITH {PANEL} SELECT {c}, count(*) AS n FROM panel GROUP BY {c})"""
    for c in ("disease", "department", "municipality")
), *(
    f"""SELECT '{c}', NULL, NULL, quantile_cont({c}::DOUBLE, 0.5), NULL, NULL, NULL FROM (WITH {PANEL} SELECT {c} FROM panel)"""
    for c in ("year", "month", "total_cases")
)])
ORACLES["forest_nodes"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS forest, what, n FROM (
  SELECT 'rows scored' AS what, {N} AS n FROM (WITH {PANEL} SELECT * FROM panel)
  UNION ALL VALUES ('rows that differ', 0), ('unbalanced nodes', 0), ('trees', {trees}), ('trees of one node', 0))"""
    for name, trees in (("sqrt_7", 7), ("sqrt_10", 10))
)
ORACLES["published_constant"] = f"""WITH {PANEL},
scaffold AS (SELECT e.*, CAST(m.m AS INT) AS month, 2024 AS year
  FROM (SELECT DISTINCT disease, department, municipality FROM counts) e
  CROSS JOIN range(1, 13) AS m(m)),
profiled AS ({with_climate('scaffold', False)}),
ready AS (SELECT *, {SEASON} FROM profiled)
SELECT disease, month, department, municipality AS city, 9 AS estimated_cases, 9 AS estimated_outbreak_proxy,
  '{presets.OUTBREAK_LEVELS[1][1]}' AS outbreak_level, 'GLOBAL' AS model_used, thermal_floor,
  avg_temp_c, precipitation_mm, humidity_pct, tropical_score, climate_risk_score, is_rainy_season,
  is_vector_favorable, 9.0::DOUBLE AS cases_previous_month, 9.0::DOUBLE AS cases_previous_2_month_mean,
  9.0::DOUBLE AS cases_previous_3_month_mean, 0.0::DOUBLE AS validation_mae, 0.0::DOUBLE AS validation_wape_pct
FROM ready"""
ORACLES["training_panel"] = f"""WITH {TEMPORAL},
t AS (SELECT disease, year, department, municipality, month, total_cases, cases_previous_month,
  cases_previous_2_month_mean, {six('cases_previous_3_month_mean')} AS cases_previous_3_month_mean,
  {six('cases_previous_6_month_mean')} AS cases_previous_6_month_mean,
  cases_previous_3_month_sum, cases_previous_6_month_sum,
  cases_previous_month - p2 AS cases_trend_1m,
  {six('cases_previous_3_month_mean - cases_previous_6_month_mean')} AS cases_trend_3m
FROM lagged),
profiled AS ({with_climate('t', False)})
SELECT *, {SEASON} FROM profiled"""
ORACLES["stratified_split"] = f"""WITH {PANEL},
c AS (SELECT quantile_cont(ln(1 + total_cases), [0.2, 0.4, 0.6, 0.8]) AS cuts,
             min(ln(1 + total_cases)) AS low FROM panel),
b AS (SELECT panel.*, CAST(len(list_filter(list_distinct(c.cuts),
        lambda cut: cut > c.low AND cut < ln(1 + total_cases))) AS INT) AS bin FROM panel, c),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws('|', disease, department, municipality,
    CAST(year AS VARCHAR), CAST(month AS VARCHAR), '{presets.SEED}'))) AS place,
  round_even(count(*) OVER (PARTITION BY bin) * 0.2::DOUBLE, 0) AS n_test FROM b)
SELECT disease, department, municipality, year, month, total_cases, bin, place <= n_test AS is_test FROM r"""

# --- exploration ----------------------------------------------------------------------------------


def four(e: str) -> str:
    return f"round_even(({e}) * 10000, 0) / 10000"


NUMERIC_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, CAST(NULL AS BIGINT) AS "unique",
  CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, {four(f'avg({c})')} AS mean,
  {four(f'stddev_samp({c})')} AS std, {four(f'min({c})')} AS min,
  {four(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q25, {four(f'quantile_cont({c}::DOUBLE, 0.5)')} AS q50,
  {four(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q75, {four(f'max({c})')} AS max FROM e"""
    for c in ("user_id", "value")
)
TEXT_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}', CAST(sum(n) AS BIGINT), CAST(count(*) AS BIGINT),
  (SELECT {c} FROM (SELECT {c}, count(*) AS n FROM e WHERE {c} IS NOT NULL GROUP BY 1)
   ORDER BY n DESC, {c} LIMIT 1), CAST(max(n) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM (SELECT {c}, count(*) AS n FROM e WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in ("event_type", "props", "day")
)
ORACLES["describe_table"] = f"""
WITH e AS (SELECT user_id, value, event_type, props, CAST(CAST(ts AS DATE) AS VARCHAR) AS day
           FROM events)
{NUMERIC_DESCRIBE} UNION ALL {TEXT_DESCRIBE}"""
NULL_ROWS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS nulls,
  round_even(count(*) FILTER ({c} IS NULL) * 10000.0::DOUBLE / count(*), 0) / 100 AS pct FROM cases"""
    for c in COLUMNS.split(", ")
)
ORACLES["null_profile"] = f"WITH {CASES} SELECT * FROM ({NULL_ROWS}) WHERE nulls > 0"
CORR = [
    "edad_promedio", "pct_femenino", "total_casos", "total_casos_lag_2w",
    "total_casos_lag_4w", "total_casos_ma4",
]
ORACLES["correlation_matrix"] = f"""WITH {WEEKLY},
lagged AS (SELECT *, lag(total_casos, 2) OVER w AS total_casos_lag_2w,
    lag(total_casos, 4) OVER w AS total_casos_lag_4w,
    avg(total_casos) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS total_casos_ma4
  FROM weekly WINDOW w AS (PARTITION BY enfermedad, departamento ORDER BY "año", SEMANA))
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {six(f'corr({a}::DOUBLE, {b}::DOUBLE)')} AS corr FROM lagged"
    for a in CORR for b in CORR
)
ORACLES["seasonality"] = f"""WITH {WEEKLY}
SELECT SEMANA, {six('avg(total_casos)')} AS mean_total_casos FROM weekly GROUP BY 1"""
ORACLES["national_series"] = f"""WITH {WEEKLY}
SELECT "año", SEMANA, CAST(sum(total_casos) AS BIGINT) AS total_casos,
  CAST(CAST(date_trunc('week', make_date("año", 1, 7)) AS DATE) + (SEMANA - 1) * 7 AS DATE) AS fecha
FROM weekly GROUP BY 1, 2"""
ORACLES["risk_distribution"] = f"""WITH {WEEKLY}
SELECT risk_label, {N} AS count FROM weekly GROUP BY 1"""
ORACLES["total_by_department"] = f"""WITH {WEEKLY}
SELECT departamento, CAST(sum(total_casos) AS BIGINT) AS total_casos FROM weekly GROUP BY 1
ORDER BY total_casos DESC, departamento LIMIT 15"""
ORACLES["top_departments_semi"] = f"""WITH {WEEKLY},
t AS (SELECT departamento FROM weekly GROUP BY 1
      ORDER BY sum(total_casos) DESC, departamento LIMIT 3)
SELECT enfermedad, departamento AS department, "año", SEMANA, total_casos
FROM weekly WHERE departamento IN (SELECT departamento FROM t)"""
ORACLES["box_stats"] = f"""WITH {WEEKLY},
q AS (SELECT departamento, CAST(count(*) AS BIGINT) AS n,
    quantile_cont(total_casos::DOUBLE, 0.25) AS q1, quantile_cont(total_casos::DOUBLE, 0.5) AS median,
    quantile_cont(total_casos::DOUBLE, 0.75) AS q3 FROM weekly
  WHERE departamento IN (SELECT departamento FROM weekly GROUP BY 1
                         ORDER BY sum(total_casos) DESC, departamento LIMIT 5)
  GROUP BY 1),
j AS (SELECT q.*, total_casos AS v, total_casos BETWEEN q1 - 1.5 * (q3 - q1)
        AND q3 + 1.5 * (q3 - q1) AS inside FROM weekly JOIN q USING (departamento))
SELECT departamento, n, q1, median, q3, min(v) FILTER (inside) AS whisker_low,
  max(v) FILTER (inside) AS whisker_high, CAST(count(*) FILTER (NOT inside) AS BIGINT) AS outliers
FROM j GROUP BY 1, 2, 3, 4, 5"""
SOURCE_ROWS = ", ".join(str(row) for row in presets.SOURCES)
ORACLES["source_counts"] = f"""WITH {CASES},
d AS (SELECT ['Dengue', 'Malaria', 'Chikungunya'][length(enfermedad) % 3 + 1] AS disease,
        {N} AS n FROM cases GROUP BY 1)
SELECT s.*, d.n FROM (VALUES {SOURCE_ROWS}) AS s({', '.join(presets.SOURCE_COLUMNS)})
LEFT JOIN d USING (disease)"""
