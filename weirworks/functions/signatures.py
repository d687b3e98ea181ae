"""Failure signatures and migration rules: fixed patterns, and what each one points to."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Signature:
    id: str
    pattern: str
    confidence: float
    cause: str
    fix: str
    unless: str | None = None


# Rule ids, patterns (any case), confidences and exclusions. Rules of equal confidence keep this order.
SIGNATURES = (
    Signature("empty-read", r"Illegal empty schema|does not support writing empty or nested empty schemas", 0.9,
              "The source returned no rows, so there was no schema to write.", "Look at the source: its path, its bookmark, its partition predicate."),
    Signature("lakeformation-npe", r"NullPointerException.*(getCatalogSource|GlueCatalog|writeDynamicFrame)|java\.lang\.NullPointerException.*catalog", 0.7,
              "A table grant is missing for the role.", "Grant the role select (or insert) on the table."),
    Signature("passrole", r"is not authorized to perform: iam:PassRole", 0.95,
              "The caller may not hand the job its role.", "Allow iam:PassRole on the job role for the caller."),
    Signature("vpc-endpoint", r"Could not find S3 endpoint or NAT gateway|VPC S3 endpoint validation failed", 0.95,
              "The subnet has no way to reach S3.", "Add an S3 gateway endpoint or a NAT route to the subnet."),
    Signature("sg-self-ref", r"At least one security group must open all ingress ports|security group.*self.referencing", 0.9,
              "Workers may not talk to each other.", "Add an all-TCP inbound rule whose source is the group itself."),
    Signature("eni-exhausted", r"InsufficientFreeAddressesInSubnet|Insufficient free addresses|not enough free addresses", 0.9,
              "The subnet has fewer free addresses than the job has workers.", "Use a larger subnet or fewer workers."),
    Signature("disk-not-memory", r"No space left on device|SparkOutOfMemoryError.*spill", 0.85,
              "Shuffle files filled a worker's disk.", "Shuffle less, or give workers more local storage."),
    Signature("driver-oom", r"java\.lang\.OutOfMemoryError.*(Java heap space|GC overhead).*driver|Container killed.*driver|driver.*exceeded memory", 0.75,
              "The driver held too much.", "Do not collect to the driver; shrink broadcasts and file listings."),
    Signature("executor-oom", r"Container killed by YARN for exceeding memory limits|ExecutorLostFailure.*memory", 0.75,
              "One task held too much, often a hot key.", "Check the key distribution and salt the hot key."),
    Signature("access-denied-tempdir", r"(AccessDenied|Access Denied|403).*(TempDir|temporary|/temp/)", 0.85,
              "The role may not use the temporary folder.", "Grant the role read, write and delete on the temporary folder."),
    Signature("access-denied", r"AccessDenied|Access Denied|s3:GetObject.*denied|403 Forbidden", 0.6,
              "Storage refused the role.", "Check the role policy, the bucket policy and the key policy.", unless=r"(TempDir|temporary)"),
    Signature("entity-not-found", r"EntityNotFoundException|Table .* not found|Database .* not found", 0.7,
              "The table is absent, or the role may not see it.", "Check the name, then the catalog permissions."),
    Signature("job-name-arg", r"GlueArgumentError.*JOB_NAME|the following arguments are required: --JOB_NAME", 0.9,
              "The script runs without its job name argument.", "Pass a JOB_NAME argument."),
    Signature("bookmark-empty", r"bookmark.*(no new|empty)|processed 0 files.*bookmark", 0.7,
              "All files were consumed by earlier runs.", "Reset the bookmark, or check that new files arrived."),
    Signature("glueparquet-local", r"glueparquet.*not supported|format glueparquet", 0.8,
              "This runtime lacks that writer.", "Write parquet instead."),
    Signature("unresolved-column", r"UNRESOLVED_COLUMN|cannot be resolved|A column or function parameter with name", 0.8,
              "A column is missing at that step, or the frame was empty.", "Check the row count of the step before, then renames and drops."),
    Signature("py4j-wall", r"Py4JJavaError|py4j\.protocol\.Py4JError|An error occurred while calling", 0.4,
              "A JVM exception came up through Python.", "Read the last 'Caused by' of the JVM stack."),
    Signature("exit-code", r"Command failed with exit code (1|10|137|139)", 0.5,
              "A wrapper message: the process ended with an error.", "Look for the exception further up in the error log.",
              unless=r"(OutOfMemory|No space left|AccessDenied|Py4J)"),
    Signature("no-logs", r"no log streams|log group does not exist|ResourceNotFoundException.*log", 0.8,
              "The role may not write logs.", "Grant the role the log permissions."),
    Signature("concurrent-runs", r"ConcurrentRunsExceededException", 0.95,
              "The job already runs as often as allowed.", "Raise its concurrency, or wait."),
    Signature("resource-unavailable", r"ResourceNumberLimitExceededException|Resource unavailable|capacity", 0.6,
              "An account or region limit was reached.", "Check quotas and spread the start times."),
    Signature("crawler-vpc", r"Verify the permissions in the policies attached to the IAM role|crawler.*permission", 0.6,
              "Worded as permissions, mostly a network fault.", "Test the connection, its subnet and its security group."),
    Signature("jdbc-driver", r"No suitable driver|ClassNotFoundException.*Driver", 0.85,
              "The JDBC driver is not on the classpath.", "Attach the driver jar and name its class."),
    Signature("kms", r"KMS\.|AccessDeniedException.*kms|not authorized to perform: kms:", 0.8,
              "An encryption key refused the role.", "Grant the role use of the key, in both policies."),
    Signature("throttling", r"ThrottlingException|Rate exceeded|SlowDown", 0.7,
              "A service throttled the job.", "List fewer partitions, spread prefixes, retry with back-off."),
    Signature("timeout", r"Job run timed out|exceeded the timeout|Execution timed out", 0.9,
              "The run reached its time limit.", "Raise the limit, or find the stage that stalled."),
    Signature("connection-timeout", r"Connection timed out|connect timed out|Communications link failure", 0.75,
              "The data source cannot be reached.", "Check routes and security groups of the connection."),
    Signature("csv-schema", r"cannot resolve.*given input columns|Malformed.*CSV|Number of columns", 0.6,
              "The files have other columns than expected.", "Preview the source and fix its header setting."),
    Signature("version-mismatch", r"requires Glue version|not supported in Glue|Unsupported.*version", 0.7,
              "The runtime version lacks a feature.", "Check the migration report for this job."),
)

# Handles that differ from run to run and their stand-in.
HANDLE, HANDLE_MARK = r"\bo\d{2,}\b", "o…"


@dataclass(frozen=True)
class MigrationRule:
    pattern: str
    severity: str
    title: str


# Patterns looked for in job scripts, with severity and title.
MIGRATION_RULES = (
    MigrationRule(r"(?i)\bfrom\s+pyspark\.sql\.functions\s+import\s+\*", "info", "Star import from pyspark.sql.functions"),
    MigrationRule(r"\.toPandas\(\)", "warn", "toPandas()"),
    MigrationRule(r"(?i)spark\.sql\.legacy\.", "warn", "A legacy Spark flag"),
    MigrationRule(r"(?i)datasource\s*=|\bDataSource\d", "info", "Classic generated identifiers"),
    MigrationRule(r"(?i)\bglueparquet\b", "info", "glueparquet writer"),
    MigrationRule(r"(?i)\bjson\.loads\(.*\.collect\(\)", "warn", "collect() into the driver"),
    MigrationRule(r"(?i)\bpython_?version\s*=\s*[\"']2", "error", "Python 2"),
    MigrationRule(r"(?i)\bfindspark|\bpy4j\.java_gateway", "warn", "Direct JVM gateway use"),
    MigrationRule(r"(?i)\bfrom\s+awsglue\.transforms\s+import\s+\*", "info", "Star import from awsglue.transforms"),
    MigrationRule(r"(?i)create_dynamic_frame_from_", "info", "Deprecated helper name"),
    MigrationRule(r"(?i)\bsc\s*=\s*SparkContext\(\)", "info", "SparkContext()"),
)

# Key names whose values are hidden, and what is shown instead.
SECRET_KEY, SECRET_MASK = r"(?i)(secret|password|passwd|token|api[_-]?key|credential)", "••••"

# Log streams kept out of the console, insight streams and what they hold, error highlight.
PROGRESS_SUFFIX = "-progress-bar"
INSIGHT_STREAMS = {"job-insights-rca-driver": "rootCause", "job-insights-rule-driver": "guidance"}
INSIGHT_GROUPS = ("error", "logs-v2")
ERROR_WORDS = r"ERROR|Exception|Traceback"
