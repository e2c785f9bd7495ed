"""Fixed values of the hazard model. Thresholds are defaults of parameters."""

# --- fixed values: risk matrix, rows RA 0-4, columns ICC 0-4 -----------------
RD_MATRIX = (
    (0, 0, 0, 0, 0),
    (0, 1, 2, 3, 4),
    (0, 2, 3, 4, 4),
    (0, 3, 4, 4, 4),
    (0, 4, 4, 4, 4),
)

# --- fixed values: level names ----------------------------------------------
LEVELS = ("Monitoramento", "Observação", "Atenção", "Alerta", "Alerta Máximo")
OUT_OF_COVERAGE = "Fora de cobertura"
NO_RA = "SEM DADO - RA nao mapeado"

# --- fixed values: the four regions -----------------------------------------
# id, name, road, K, CPC thresholds, 24 h thresholds (mm), lat/lon rectangle
REGIONS = (
    (1, "Mogi-Bertioga", "SP-098", 1000.0, (1.0, 3.0, 6.0, 15.0), (110.0, 160.0, 200.0, 280.0),
     ((-23.42, -46.28), (-23.42, -45.98), (-23.95, -45.98), (-23.95, -46.28))),
    (2, "Caraguatatuba-Ubatuba", "SP-055", 400.0, (1.0, 6.0, 12.0, 24.0), (70.0, 80.0, 120.0, 143.0),
     ((-23.18, -45.30), (-23.18, -44.80), (-23.78, -44.80), (-23.78, -45.30))),
    (3, "São Sebastião", "SP-055", 200.0, (1.0, 8.0, 16.0, 24.0), (60.0, 85.0, 110.0, 126.0),
     ((-23.62, -45.95), (-23.62, -45.30), (-23.95, -45.30), (-23.95, -45.95))),
    (4, "Santos-Bertioga", "SP-055", 1000.0, (1.0, 4.0, 8.0, 16.0), (150.0, 200.0, 230.0, 300.0),
     ((-23.78, -46.40), (-23.78, -45.95), (-24.10, -45.95), (-24.10, -46.40))),
)

# --- fixed values: rain index -----------------------------------------------
CPC_EXPONENT = -0.9
DRY_AC96_MM = 0.5
WINDOW_HOURS = (18, 24, 72, 96)
SATELLITE_LAG_H = 3
DEGRADED_MISSING_24H = 6
READY_HOURS = 24
HISTORY_MAX_DAYS = 1460
HISTORY_CYCLES = 24

# --- fixed values: gauge correction (30 km) ---------------------------------
EARTH_RADIUS_KM = 6371.0
CORRECTION = dict(radius_km=30.0, max_weight=0.85, factor_min=0.1, factor_max=3.0, dry_mm=0.5,
                  snap_km=0.5, max_age_h=3)
DRY_GUARD = dict(min_stations=3, max_nearest_km=15.0, max_gauge_mm=2.0, min_sat_mm=50.0,
                 min_fraction=0.8, min_coverage_h=18.0)
# --- fixed values: gauges as primary source (15 km) -------------------------
PRIMARY = dict(radius_km=15.0, coverage=0.9, window_h=96, min_distance_km=0.5, recent_h=6, full_h=6)
SUSPECT = dict(radius_km=10.0, dry_mm=0.5, wet_mm=5.0, min_neighbors=3, min_hours=18)
STATION_BOX = dict(lat=(-35.0, 5.0), lon=(-75.0, -30.0))

# --- fixed values: forecast, alerts, late data ------------------------------
FORECAST = dict(run_step_h=6, lookback_runs=12, max_lead_h=180, horizons=(6, 24))
ALERTS = dict(threshold=3, cooldown_h=6)
REFETCH = dict(fresh_h=4, stale_h=24, recheck_h=24, ttl_days=30)
AXIS_CUTOFF_KM = 30.0
SAME_ROAD_CUTOFF_KM = 1.5
ANY_ROAD_CUTOFF_KM = 0.5
TELEMETRY_KEEP = 2016

# --- fixed values: histogram edges ------------------------------------------
AC24H_EDGES = (0.0, 5.0, 15.0, 30.0, 60.0, 120.0)
AC96H_EDGES = (0.0, 10.0, 30.0, 60.0, 120.0, 220.0)
INTENSITY_EDGES = (0.0, 1.0, 3.0, 6.0, 12.0, 25.0)

# --- fixed values: fire classes ---------------------------------------------
RF_NO_DATA = "SEM_DADO"
RF_ORDER = ("minimo", "baixo", "medio", "alto", "critico", "SEM_DADO")
RF_RANK = {"minimo": 1, "baixo": 2, "medio": 3, "alto": 4, "critico": 5}
RF_LIMITS = (0.15, 0.40, 0.70, 0.95)
FIRE_HORIZONS = ("observado", "D+1", "D+2", "D+3")

# --- fixed values: unit counts per region, municipality and scale -----------
# region, municipality, scale, units, official length in km
UNIT_QUOTAS = (
    (1, "Mogi das Cruzes", "25K", 41, 14.28),
    (1, "Biritiba Mirim", "25K", 22, 8.51),
    (1, "Biritiba Mirim", "1K", 5, 0.66),
    (1, "Bertioga", "10K", 11, 5.68),
    (1, "Bertioga", "1K", 32, 5.54),
    (2, "Caraguatatuba", "10K", 68, 22.32),
    (2, "Caraguatatuba", "1K", 30, 7.19),
    (2, "Ubatuba", "10K", 30, 16.40),
    (2, "Ubatuba", "1K", 60, 12.85),
    (3, "São Sebastião", "10K", 103, 34.60),
    (3, "São Sebastião", "1K", 252, 43.56),
    (4, "Bertioga", "10K", 87, 36.59),
    (4, "Bertioga", "1K", 16, 5.92),
    (4, "Santos", "10K", 36, 11.56),
    (4, "Santos", "1K", 16, 3.21),
)

# --- fixed values: slope class quotas, region, scale, units in RA 0-4 -------
RA_GEO_QUOTAS = (
    (1, "25K", (19, 11, 10, 4, 19)),
    (1, "10K", (0, 11, 0, 0, 0)),
    (2, "10K", (0, 97, 1, 0, 0)),
    (3, "10K", (0, 103, 0, 0, 0)),
    (4, "10K", (0, 123, 0, 0, 0)),
    (1, "1K", (0, 0, 16, 14, 7)),
    (2, "1K", (8, 10, 11, 28, 33)),
    (3, "1K", (7, 33, 63, 69, 80)),
    (4, "1K", (5, 8, 5, 12, 2)),
)

# --- fixed values: flood class quotas, region, scale, units in RA 0-4 -------
RA_HID_QUOTAS = (
    (1, "25K", (44, 19, 0, 0, 0)),
    (1, "10K", (0, 11, 0, 0, 0)),
    (2, "10K", (0, 89, 9, 0, 0)),
    (3, "10K", (0, 99, 4, 0, 0)),
    (4, "10K", (0, 117, 6, 0, 0)),
    (1, "1K", (37, 0, 0, 0, 0)),
    (2, "1K", (84, 0, 0, 6, 0)),
    (3, "1K", (248, 0, 0, 4, 0)),
    (4, "1K", (28, 0, 0, 4, 0)),
)

# --- fixed values: critical stretches with the units per RA class 0-4 -------
# channel, region, unit office, road, first km, last km, units in RA 0-4
CRITICAL_STRETCHES = (
    ("geo", 3, "05.04", "SP-055", 128.0, 153.0, (4, 32, 29, 29, 41)),
    ("geo", 3, "05.04", "SP-055", 156.0, 162.0, (1, 7, 9, 14, 17)),
    ("geo", 4, "05.04", "SP-055", 235.0, 238.0, (0, 6, 1, 2, 2)),
    ("geo", 2, "06.04", "SP-055", 53.6, 102.0, (7, 95, 12, 28, 33)),
    ("geo", 3, "06.04", "SP-055", 114.0, 127.8, (0, 27, 7, 14, 16)),
    ("geo", 1, "10.04", "SP-098", 77.0, 98.0, (1, 53, 5, 6, 16)),
    ("hidro", 3, "05.04", "SP-055", 178.1, 191.4, (2, 30, 0, 0, 0)),
    ("hidro", 4, "05.04", "SP-055", 191.4, 223.6, (4, 67, 1, 3, 0)),
    ("hidro", 2, "06.04", "SP-055", 92.5, 93.5, (7, 0, 0, 0, 0)),
    ("hidro", 2, "06.04", "SP-055", 96.5, 97.5, (0, 3, 0, 0, 0)),
    ("hidro", 2, "06.04", "SP-055", 111.5, 112.5, (3, 5, 0, 0, 0)),
)

# --- fixed values: response protocol ----------------------------------------
# level, colour, description, main agency, standby, inspection, actions ("agency: text")
PROTOCOL = (
    (0, "#22c55e", "Monitoramento automatico", "COI - DER/SP", False, False, (
        "COI-DER/SP: monitoramento das condicoes de chuvas e mudancas de nivel",
        "CCO/UBA-DER/SP: monitoramento complementar das condicoes",
        "CEPDEC: acompanhamento do monitoramento")),
    (1, "#eab308", "Monitoramento e prontidao de equipes de emergencia", "COI - DER/SP", True, False, (
        "COI-DER/SP: comunicar ao CCO o inicio do nivel em Observacao",
        "COI-DER/SP: continuidade do monitoramento das chuvas",
        "CCO-DER/SP: iniciar nivel em Observacao na regiao da UBA",
        "UBA-DER/SP: atender ao nivel, permanecer a disposicao do CCO",
        "CEPDEC: continuidade do monitoramento das condicoes de chuvas")),
    (2, "#f97316", "Vistorias expeditas e prontidao das equipes", "COI / CCO - DER/SP", True, True, (
        "COI-DER/SP: comunicar ao CCO o inicio do nivel em Atencao",
        "COI-DER/SP: continuidade do monitoramento das chuvas",
        "CCO-DER/SP: iniciar nivel em Atencao, solicitar prontidao das equipes da UBA",
        "UBA-DER/SP: posicionar equipes para prontidao aos acionamentos",
        "UBA-DER/SP: iniciar vistorias expeditas, priorizando trechos criticos",
        "PM Rodoviaria: informes complementares sobre condicoes da via",
        "CEPDEC: acompanhamento e apoio ao monitoramento")),
    (3, "#ef4444", "Vistorias em campo obrigatorias nos trechos criticos", "UBA / CCO - DER/SP", True, True, (
        "COI-DER/SP: comunicar ao CCO o inicio do nivel em Alerta",
        "COI-DER/SP: continuidade do monitoramento e acionamento de outros orgaos",
        "CCO-DER/SP: mobilizar equipes de conservacao para vistorias",
        "UBA-DER/SP: vistorias em campo obrigatorias nos trechos criticos",
        "UBA-DER/SP: em caso de confirmacao de desastre, acionar Plano de Contingencia",
        "PM Rodoviaria: apoio ao controle de trafego e sinalizacao",
        "CEPDEC: alerta as Defesas Civis municipais da area de abrangencia")),
    (4, "#a855f7", "Vistorias intensivas e acionamento do Plano de Contingencia", "UBA / CCO / COI - DER/SP", True, True, (
        "COI-DER/SP: comunicar Alerta Maximo e acionar todos os orgaos envolvidos",
        "CCO-DER/SP: mobilizar equipes de conservacao e apoio emergencial",
        "UBA-DER/SP: vistorias intensivas em todos os trechos criticos",
        "UBA-DER/SP: confirmacao de ocorrencia -> acionamento PLANO DE CONTINGENCIA",
        "UBA-DER/SP: solicitar complementacao de equipes e equipamentos das UBAs vizinhas",
        "PM Rodoviaria: controle de trafego, interdicao se necessario, sinalizacao",
        "CEPDEC: acionamento do PPDC municipal, retirada preventiva se necessario",
        "Saude/Resgate: prontidao para atendimento de vitimas")),
)
