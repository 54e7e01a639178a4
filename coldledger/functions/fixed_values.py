"""Patterns, formats, words and constants that results depend on."""

# --- usage report -----------------------------------------------------------
COL_OPERATION = "lineItem/Operation"
COL_RESOURCE = "lineItem/ResourceId"
COL_INTERVAL = "identity/TimeInterval"
COL_AMOUNT = "lineItem/UsageAmount"
COL_RATE = "lineItem/UnblendedRate"
USAGE_COLUMNS = (COL_OPERATION, COL_RESOURCE, COL_INTERVAL, COL_AMOUNT, COL_RATE)

SNAPSHOT_OPERATION = "CreateSnapshot"
SNAPSHOT_ARN = r"^arn:[^:]+:ec2:([^:]+):(\d+):snapshot/(snap-[a-z0-9]+)\z"
OFFSET_ENDING = r"T.*[+-]\d{2}:?\d{2}\z"
# Leading number of a text; everything after it is ignored.
NUMBER_PREFIX = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
MONTH_SECONDS = 30 * 86400

# --- report lines -----------------------------------------------------------
REGION_LINE = "Region %s ($%s/month for %d snapshot%s)"
VOLUME_LINE = "%s (%dGB%s): %d GB total, $%s/month for %d snapshot%s"
VOLUME_CHANGE = ", average snapshot change %s%%"
SNAPSHOT_LINE = "  %22s  %s  %s GB"
SNAPSHOT_CHANGE = " (%s%%)"
DELETED_LABEL = ", deleted"

# --- manifests --------------------------------------------------------------
HASH_CHARS = 32
MIN_RECORD_BYTES = HASH_CHARS + 1
READ_CHUNK_BYTES = 1024 * 1024
ONLY_IN = "Only in %s: %s"
DIFFERENCE = "Difference in file: %s\n%s: %s\n%s: %s"
COUNTS_DIFFER = "File counts differ!"
COUNT_LINE = "%s: %d files, %s: %d files"

# --- catalogue --------------------------------------------------------------
STATUS_COMPLETED = "completed"
STATE_MIGRATE = "migrate"
STATE_MIGRATED = "migrated"
STATE_VALIDATING = "validating"
STATE_VALIDATED = "validated"
CODECS = ("lz4", "zstd")
ENCRYPTED_SUFFIX = ".gpg"
IMAGE_SUFFIX = ".img"
ARCHIVE_SUFFIX = ".tar"
# Characters outside the basic plane count as two units, each replaced by "_".
WIDE_CHARACTER = r"[\x{10000}-\x{10FFFF}]"
ILLEGAL_TAG_CHARACTER = (
    r"[^a-zA-Z0-9+=._:/\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}-]"
)
TAG_LIMIT = 256
RESERVED_TAG_PREFIX = "aws:"
NAME_TAG = "Name"
METADATA_STARTTIME = "snapshot-starttime"
METADATA_SNAPSHOTID = "snapshot-snapshotid"
METADATA_VOLUMESIZE = "snapshot-volumesize"
METADATA_VOLUMEID = "snapshot-volumeid"
METADATA_DESCRIPTION = "snapshot-description"
METADATA_SIZE = "uncompressed-size"
STANDARD_VOLUME_LIMIT_GB = 1024
VOLUME_STANDARD = "standard"
VOLUME_LARGE = "gp2"
SUCCESS_HEADER = "These snapshots validated successfully:"
OBJECT_MISSING = "\"s3://%s/%s\" should exist, but wasn't readable/found!"
ARCHIVE_DIFFERS = 'Local directory and contents of S3 tar "s3://%s/%s" differ!'
IMAGE_DIFFERS = "Hash of decompressed S3 object (%s) does not match local temporary volume (%s)"
FAILURE_HEADER = "These snapshots failed to validate:"

# --- uploads ----------------------------------------------------------------
USABLE_PARTS = 9_000
PART_HEADROOM_BYTES = 10 * 1024 * 1024
MIN_PART_BYTES = 5 * 1024 * 1024
LEVEL_MIN, LEVEL_MAX = 1, 19
PUT_PRICE = 0.005 / 1000
READ_BYTES_PER_SECOND = 3.5 * 1024 * 1024

# --- storage prices, $/GB-month, and minimum billed days ---------------------
SNAPSHOT_PRICE = 0.05
TIERS = (
    ("standard", 0.023, 0),
    ("infrequent", 0.0125, 30),
    ("archive", 0.004, 90),
)
YEAR_OF_SNAPSHOTS = 12
