"""Declarations of the registers: columns, types, ids, and the person field each column fills."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "seconds": T.IntegerType(),
}


@dataclass(frozen=True)
class RegisterField:
    """One delivered column.

    ``aliases`` are other names the same column is delivered under. ``expression`` replaces the plain
    type conversion when given: it maps the raw column to the person field.
    """

    source: str
    target: str
    kind: str = "string"
    aliases: tuple[str, ...] = ()
    expression: Column | None = None

    @property
    def data_type(self) -> T.DataType:
        return _TYPES[self.kind]

    @property
    def names(self) -> tuple[str, ...]:
        return (self.source, *self.aliases)


@dataclass(frozen=True)
class RegisterSpec:
    """A register. ``id_field`` must be filled for a row to count.

    ``parent`` and ``parent_key`` name the register, and the shared column, through which rows
    without a person id reach one.
    """

    name: str
    id_column: str
    fields: tuple[RegisterField, ...]
    parent: str | None = None
    parent_key: str | None = None
    path_hints: tuple[str, ...] = field(default=())

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.source, f.data_type, f.source != self.id_column) for f in self.fields])

    @property
    def id_field(self) -> str:
        return next(f.target for f in self.fields if f.source == self.id_column)

    @property
    def targets(self) -> tuple[str, ...]:
        return tuple(f.target for f in self.fields)

    def find(self, source: str) -> RegisterField:
        return next(f for f in self.fields if source in f.names)


def parse_fields(text: str) -> tuple[RegisterField, ...]:
    """Fields from ``SOURCE[|ALIAS...] target [kind]`` lines."""
    fields = []
    for line in text.strip().splitlines():
        source, target, *kind = line.split()
        name, *aliases = source.split("|")
        fields.append(RegisterField(name, target, kind[0] if kind else "string", tuple(aliases)))
    return tuple(fields)


# Delivered column names, person fields and types of the thirteen registers.
_BEF = """
PNR pnr
KOEN gender
FOED_DAG birth_date date
MOR_ID mother_pnr
FAR_ID father_pnr
FAMILIE_ID family_id
AEGTE_ID|E_FAELLE_ID spouse_pnr
ALDER age int
ANTPERSF family_size int
ANTPERSH household_size int
BOP_VFRA residence_from date
FAMILIE_TYPE family_type int
IE_TYPE immigration_type
PLADS position_in_family int
OPR_LAND origin
STATSB citizenship_status
CIVST marital_status
CIV_VFRA marital_date date
KOM municipality_code
REG regional_code
HUSTYPE household_type int
ANTAL_BOERN children_count int
"""
_AKM = """
PNR pnr
SOCIO13 socioeconomic_status int
"""
_IND = """
PNR pnr
PERINDKIALT_13 annual_income double
LOENMV_13 employment_income double
VERSION version
YEAR|AAR income_year int
"""
_UDDF = """
PNR pnr
CPRTJEK cpr_check
CPRTYPE cpr_type
HFAUDD education_code int
HF_KILDE education_source int
HF_VFRA education_valid_from date
HF_VTIL education_valid_to date
INSTNR education_institution int
VERSION uddf_version
"""
_VNDS = """
PNR pnr
INDUD_KODE|HAEND_KODE event_type
HAEND_DATO event_date date
"""
_MFR = """
CPR_BARN pnr
FOEDSELSDATO birth_date date
CPR_MODER mother_pnr
CPR_FADER father_pnr
VAEGT birth_weight int
LAENGDE birth_length int
SVLNGD gestational_age int
APGAR5 apgar_score int
FLERFOLD birth_order int
PLURALITY plurality int
"""
_DOD = """
PNR pnr
DODDATO death_date date
C_AARSAG death_cause
C_TILSTAND underlying_death_cause
"""
_DODSAARSAG = """
PNR pnr
C_AARSAG death_cause
C_TILSTAND death_condition
D_DATO death_date date
"""
_LPR_ADM = """
PNR pnr
C_ADIAG action_diagnosis
C_AFD department_code
C_HAFD referring_department
C_HENM referral_method
C_HSGH referring_hospital
C_INDM admission_method
C_KOM municipality_code
C_KONTAARS contact_reason
C_PATTYPE patient_type
C_SGH hospital_code
C_SPEC specialty_code
C_UDM discharge_method
CPRTJEK cpr_check
CPRTYPE cpr_type
K_AFD department_key
RECNUM record_number
VERSION version
D_HENDTO referral_date date
D_INDDTO admission_date date
D_UDDTO discharge_date date
V_ALDDG age_days int
V_ALDER age int
V_INDMINUT admission_minute int
V_INDTIME admission_hour int
V_SENGDAGE length_of_stay int
V_UDTIME discharge_hour int
"""
_LPR_DIAG = """
RECNUM record_number
C_DIAG diagnosis_code
C_DIAGTYPE diagnosis_type
C_TILDIAG additional_diagnosis
LEVERANCEDATO delivery_date date
VERSION version
"""
_LPR_BES = """
RECNUM record_number
D_AMBDTO visit_date date
LEVERANCEDATO delivery_date date
VERSION version
"""
_LPR3_KONTAKTER = """
CPR|cpr pnr
DW_EK_KONTAKT|kontakt_id dw_ek_kontakt
DW_EK_FORLOEB course_id
SORENHED_IND unit_admitting
SORENHED_HEN unit_referring
SORENHED_ANS unit_responsible
dato_start|starttidspunkt start_date date
dato_slut end_date date
dato_behandling_start treatment_start_date date
dato_indberetning report_date date
tidspunkt_start start_time seconds
tidspunkt_slut end_time seconds
tidspunkt_behandling_start treatment_start_time seconds
aktionsdiagnose primary_diagnosis
kontaktaarsag contact_reason
prioritet priority
kontakttype contact_type
henvisningsaarsag referral_reason
henvisningsmaade referral_method
lprindberetningssystem reporting_system
"""
_LPR3_DIAGNOSER = """
DW_EK_KONTAKT|kontakt_id dw_ek_kontakt
diagnosekode diagnosis_code
diagnosetype|diagnose_type diagnosis_type
senere_afkraeftet later_disproved
diagnosekode_parent parent_diagnosis_code
diagnosetype_parent parent_diagnosis_type
lprindberetningssystem reporting_system
"""

# Order matters for ``path_hints``: the first register whose hint occurs in a path is taken.
REGISTERS: dict[str, RegisterSpec] = {
    spec.name: spec
    for spec in (
        RegisterSpec("lpr_adm", "PNR", parse_fields(_LPR_ADM), path_hints=("lpr_adm", "lpradm")),
        RegisterSpec("lpr_diag", "RECNUM", parse_fields(_LPR_DIAG), "lpr_adm", "RECNUM", ("lpr_diag", "lprdiag")),
        RegisterSpec("lpr_bes", "RECNUM", parse_fields(_LPR_BES), "lpr_adm", "RECNUM", ("lpr_bes", "lprbes")),
        RegisterSpec(
            "lpr3_kontakter", "CPR", parse_fields(_LPR3_KONTAKTER), path_hints=("lpr3_kontakter", "kontakter")
        ),
        RegisterSpec(
            "lpr3_diagnoser", "DW_EK_KONTAKT", parse_fields(_LPR3_DIAGNOSER), "lpr3_kontakter", "DW_EK_KONTAKT",
            ("lpr3_diagnoser", "diagnoser"),
        ),
        RegisterSpec("dodsaarsag", "PNR", parse_fields(_DODSAARSAG), path_hints=("dodsaarsag",)),
        RegisterSpec("dod", "PNR", parse_fields(_DOD), path_hints=("dod",)),
        RegisterSpec("akm", "PNR", parse_fields(_AKM), path_hints=("akm",)),
        RegisterSpec("bef", "PNR", parse_fields(_BEF), path_hints=("bef",)),
        RegisterSpec("ind", "PNR", parse_fields(_IND), path_hints=("ind",)),
        RegisterSpec("uddf", "PNR", parse_fields(_UDDF), path_hints=("uddf", "uddannelse")),
        RegisterSpec("vnds", "PNR", parse_fields(_VNDS), path_hints=("vnds", "migration")),
        RegisterSpec("mfr", "CPR_BARN", parse_fields(_MFR), path_hints=("mfr", "foedselsregister")),
    )
}

# A column that gives the register away, tried in this order.
CHARACTERISTIC_COLUMNS = (
    ("RECNUM", "lpr_adm"),
    ("PERINDKIALT_13", "ind"),
    ("PERINDKIALT", "ind"),
    ("BARSELNR", "mfr"),
    ("VEJ_KODE", "vnds"),
    ("DODDATO", "dod"),
    ("HELTID", "akm"),
    ("UDD_H", "uddf"),
)


def register(name: str) -> RegisterSpec:
    try:
        return REGISTERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown register {name!r}; known: {sorted(REGISTERS)}") from None


def register_from_path(path: str) -> RegisterSpec:
    """Register named by the last folder of a path; folders above it don't count."""
    lowered = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for spec in REGISTERS.values():
        if any(hint in lowered for hint in spec.path_hints):
            return spec
    raise ValueError(f"no register recognised in path {path!r}")


def register_from_columns(columns: list[str]) -> RegisterSpec:
    """Register recognised by a characteristic column, the population register otherwise."""
    present = set(columns)
    for column, name in CHARACTERISTIC_COLUMNS:
        if column in present:
            return REGISTERS[name]
    return REGISTERS["bef"]
