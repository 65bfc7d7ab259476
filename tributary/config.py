"""The target schema, the client vocabulary and the thresholds that the engine works by. Each is an argument elsewhere."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    type: str = "string"
    required: bool = False
    unique: bool = False
    values: tuple[str, ...] = ()
    pattern: str | None = None


# The target employee schema, in its order, which breaks ties.
FIELDS: tuple[Field, ...] = (
    Field("employeeNumber", "Employee number", required=True, unique=True),
    Field("firstName", "First name", required=True),
    Field("lastName", "Last name", required=True),
    Field("email", "Work email", "email", required=True, unique=True),
    Field("phone", "Mobile", "phone"),
    Field("dateOfBirth", "Date of birth", "date"),
    Field("dateOfJoining", "Date of joining", "date", required=True),
    Field("gender", "Gender", "enum", values=("male", "female", "other", "prefer_not_to_say")),
    Field("department", "Department", required=True),
    Field("designation", "Designation", required=True),
    Field("employmentType", "Employment type", "enum", required=True, values=("full_time", "contract", "intern", "consultant")),
    Field("status", "HR status", "enum", required=True, values=("active", "inactive", "on_notice", "terminated")),
    Field("workLocation", "Work location"),
    Field("managerEmployeeNumber", "Manager employee no."),
    Field("panNumber", "PAN", pattern="^[A-Z]{5}[0-9]{4}[A-Z]$"),
    Field("ctcAnnual", "Annual CTC", "number"),
    Field("currency", "Currency", "enum", values=("INR", "USD", "EUR")),
)
FULL_NAME = "fullName"

# Header synonyms of each target field.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "employeeNumber": ("empcode", "emp code", "emp id", "empid", "employee code", "employee no", "employee number", "employee_no", "staff id", "personnel number", "pernr", "emp id"),
    "firstName": ("first name", "firstname", "fname", "given name", "givenname"),
    "lastName": ("last name", "lastname", "lname", "surname", "family name"),
    "fullName": ("employee name", "full name", "display name", "name", "staff name"),
    "email": ("email", "work email", "official email", "email official", "office email", "corporate email", "mail", "email address"),
    "phone": ("phone", "mobile", "mobile no", "contact", "cell", "phone number", "mobile number"),
    "dateOfBirth": ("dob", "date of birth", "birth date", "birthdate", "birthday"),
    "dateOfJoining": ("doj", "date of joining", "join date", "joining date", "hire date", "hired on", "start date", "date of hire"),
    "gender": ("gender", "sex"),
    "department": ("dept", "department", "department name", "org unit", "business unit", "function"),
    "designation": ("designation", "job title", "title", "position", "role", "job role"),
    "employmentType": ("employment type", "emp type", "worker type", "contract type", "employee type"),
    "status": ("status", "emp status", "employment status", "hr status"),
    "workLocation": ("location", "work location", "office", "site", "workplace", "base location", "city"),
    "managerEmployeeNumber": ("manager", "manager id", "manager emp id", "manager_emp_id", "supervisor id", "reporting manager", "line manager"),
    "panNumber": ("pan", "pan number", "pan no", "permanent account number"),
    "ctcAnnual": ("ctc", "gross ctc", "grossctc", "annual ctc", "compensation", "salary", "annual salary", "pay"),
    "currency": ("currency", "ccy", "curr"),
}
# Headers that are leftovers for every field but the work location.
LEFTOVERS = ("username", "cost center", "pay date")

# Client words for enum values.
ENUM_SYNONYMS: dict[str, dict[str, str]] = {
    "gender": {"m": "male", "male": "male", "man": "male", "f": "female", "female": "female", "woman": "female", "w": "female", "o": "other", "other": "other", "pnts": "prefer_not_to_say", "prefer not to say": "prefer_not_to_say"},
    "employmentType": {"permanent": "full_time", "full time": "full_time", "full-time": "full_time", "ft": "full_time", "fte": "full_time", "contract": "contract", "contractor": "contract", "fixed term": "contract", "intern": "intern", "internship": "intern", "consultant": "consultant"},
    "status": {"active": "active", "a": "active", "inactive": "inactive", "on notice": "on_notice", "notice": "on_notice", "resigned": "on_notice", "terminated": "terminated", "exit": "terminated", "separated": "terminated"},
    "currency": {"inr": "INR", "rs": "INR", "₹": "INR", "usd": "USD", "$": "USD", "eur": "EUR"},
}
# Domains of private mailboxes.
PERSONAL_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "rediffmail.com")
# Display names of escalation kinds.
KIND_LABELS = {
    "mapping_ambiguous": "Ambiguous mapping",
    "mapping_competing": "Competing columns",
    "mapping_missing_required": "Required field unmapped",
    "value_ambiguous_date": "Ambiguous date",
    "value_unknown_enum": "Unknown enum value",
    "conflict_cross_file": "Cross-file conflict",
    "duplicate_fuzzy": "Possible duplicate",
    "validation_failed": "Validation failed",
}


# Thresholds of the mapping decision, years that a date may have, sizes of logs and samples.
@dataclass(frozen=True)
class Policy:
    auto_min: float = 0.82
    auto_margin: float = 0.18
    auto_certain: float = 0.92
    ignore_below: float = 0.45
    personal_domains: tuple[str, ...] = PERSONAL_DOMAINS
    numeric_conflict_escalates: bool = True
    containment_keeps_longer: bool = True
    first_year: int = 1940
    last_year: int = 2035
    event_log: int = 80
    samples: int = 8
    #: Of a vocabulary of more synonyms, the best fields are found through grams; they are the same.
    compared_synonyms: int = 2000


@dataclass(frozen=True)
class Config:
    fields: tuple[Field, ...] = FIELDS
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=lambda: SYNONYMS)
    leftovers: tuple[str, ...] = LEFTOVERS
    enum_synonyms: dict[str, dict[str, str]] = field(default_factory=lambda: ENUM_SYNONYMS)
    id_prefix: str = "apx"
    default_currency: str = "INR"
    policy: Policy = field(default_factory=Policy)

    @property
    def by_key(self) -> dict[str, Field]:
        return {f.key: f for f in self.fields}

    @property
    def required(self) -> list[str]:
        return [f.key for f in self.fields if f.required]

    def fields_frame(self, spark: SparkSession) -> DataFrame:
        """One row a field, so that scoring and validation are joins."""
        rows = [(f.key, i, f.label, f.type, f.required, list(f.values), f.pattern) for i, f in enumerate(self.fields)]
        return spark.createDataFrame(rows, "field string, ord int, label string, type string, required boolean, values array<string>, pattern string")

    def synonyms_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, i, s) for k, ways in self.synonyms.items() for i, s in enumerate(ways)]
        return spark.createDataFrame(rows, "field string, ord int, synonym string")
