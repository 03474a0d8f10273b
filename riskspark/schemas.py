"""Fixed schemas of the tables the operators exchange."""

SOURCE_FILES = "repo_id string, path string, ext string, content string, changed boolean"

FIX = (
    "struct<kind:string,credential_id:string,replacement:string,expected_text:string,"
    "start_byte:int,end_byte:int,raw_snippet:string>"
)

# fields of one finding, in order; repo_id, path and seq are added around them
FINDING_FIELDS = [
    ("rule_id", "string"),
    ("severity", "string"),
    ("state", "string"),
    ("line", "int"),
    ("message", "string"),
    ("evidence", "string"),
    ("table_name", "string"),
    ("ambiguity_reason", "string"),
    ("custom_rule_name", "string"),
    ("variable", "string"),
    ("source_file", "string"),
    ("requires_deep", "boolean"),
    ("fix", FIX),
]
FINDING = "struct<" + ",".join(f"{n}:{t}" for n, t in FINDING_FIELDS) + ">"
FINDINGS = "repo_id string, path string, seq bigint, " + ", ".join(f"{n} {t}" for n, t in FINDING_FIELDS)

TELEMETRY = (
    "id string, repo_name string, repo_owner string, remote_host string, rule_id string, severity string,"
    "file_path string, state string, source string, cli_version string, branch string, commit_sha string,"
    "metadata string, license_key_id string, organization_id string, created_at timestamp"
)
CUSTOM_RULES = (
    "repo_id string, name string, severity string, target_files array<string>,"
    "pattern struct<type:string,import_path:string,object:string,method:string,wrapper:string>"
)
FILE_EVENTS = "repo_id string, path string, ts timestamp"
TRAIL = "array<struct<path:string,line:int,text:string>>"
