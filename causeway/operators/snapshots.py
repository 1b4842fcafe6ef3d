"""Snapshots of files: classification, domains, and the difference of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories that analyses leave out, suffixes and names that decide a file's class.
IGNORED_DIRS = (".git", ".hg", ".svn", "node_modules", "dist", "build", ".next", "__pycache__", ".venv", "venv", "env", "vendor", "coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache", "target", ".idea", ".vscode", ".gradle", ".tox", "egg-info")
SEMANTIC = (".py", ".kt")
UNSUPPORTED = (".js", ".jsx", ".ts", ".tsx", ".go", ".java", ".rb", ".rs", ".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".php", ".swift", ".scala")
CONTRACT_NAMES = ("openapi.yaml", "openapi.yml", "openapi.json", "swagger.yaml", "swagger.yml")
BINARY = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".pdf", ".woff", ".woff2", ".ttf", ".otf", ".zip", ".tar", ".gz", ".bz2", ".7z", ".jar", ".class", ".so", ".dll", ".dylib", ".exe", ".pyc", ".mp3", ".mp4", ".mov", ".db", ".sqlite")
MARKERS = ("pyproject.toml", "setup.py", "requirements.txt", "package.json", "go.mod", "cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "composer.json", "gemfile")
MARKER_SUFFIXES = (".csproj",)
DEPLOYMENT_SUFFIXES = (".tf", ".tfvars", ".hcl")
CONFIG_NAMES = ("config.yaml", "config.yml", "config.json", "settings.yaml", "settings.yml", "application.yml", "application.yaml", "application.properties")


def name_of(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1)


def ignored(path: Column) -> Column:
    """A directory above the file is one that analyses leave out."""
    return F.arrays_overlap(F.array(*map(F.lit, IGNORED_DIRS)), F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/"))


def classify(path: Column) -> Column:
    suffix = suffix_of(path)
    out = F.when(ignored(path), "ignored").when(name_of(path).isin(*CONTRACT_NAMES), "api_contract").when(suffix.isin(*SEMANTIC), "semantic")
    return out.when(suffix == ".sql", "migration_candidate").when(suffix.isin(*UNSUPPORTED), "unsupported").when(suffix.isin(*BINARY), "ignored").otherwise("other")


def language(path: Column) -> Column:
    return F.when(suffix_of(path) == ".py", "python").when(suffix_of(path) == ".kt", "kotlin")


def domains(path: Column) -> Column:
    """All domains of a path, sorted; UNKNOWN alone if none."""
    name, suffix, parts = name_of(path), suffix_of(path), F.split(F.lower(path), "/")
    deploy = (name == "dockerfile") | name.startswith("docker-compose") | suffix.isin(*DEPLOYMENT_SUFFIXES) | F.arrays_overlap(parts, F.array(*map(F.lit, ("helm", "k8s", "kubernetes")))) | (F.array_contains(parts, ".github") & F.array_contains(parts, "workflows")) | name.startswith(".gitlab-ci")
    tests = {"API": name.isin(*CONTRACT_NAMES), "CONFIG": name.startswith(".env") | name.isin(*CONFIG_NAMES), "DATABASE": suffix == ".sql", "DEPENDENCY": name.isin(*MARKERS) | suffix.isin(*MARKER_SUFFIXES), "DEPLOYMENT": deploy, "SOURCE": suffix.isin(*SEMANTIC, *UNSUPPORTED)}
    found = F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in tests.items()]))
    return F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit("UNKNOWN")))


def digest(content: Column) -> Column:
    """SHA-256 of the content; 64 zeros for a file that can't be read."""
    return F.coalesce(F.sha2(content, 256), F.lit("0" * 64))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per path of either snapshot (path, sha256): SAME, ADDED, REMOVED or MODIFIED, by content."""
    both = old.select("path", F.col("sha256").alias("old_sha256")).join(new.select("path", F.col("sha256").alias("new_sha256")), "path", "full_outer")
    status = F.when(F.col("old_sha256").isNull(), "ADDED").when(F.col("new_sha256").isNull(), "REMOVED").when(F.col("old_sha256") == F.col("new_sha256"), "SAME").otherwise("MODIFIED")
    return both.select("path", status.alias("status"), "old_sha256", "new_sha256")


def counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("status") == s.upper()).alias(s) for s in ("added", "modified", "removed", "same")])


def changed(diff: DataFrame) -> DataFrame:
    return diff.filter("status <> 'SAME'")


def changed_domains(diff: DataFrame) -> DataFrame:
    """Domains that any change touches, with the number of changed files."""
    return changed(diff).select(F.explode(domains(F.col("path"))).alias("domain")).groupBy("domain").agg(F.count("*").alias("n_files"))


def pick_first(files: DataFrame, name: str) -> DataFrame:
    """The first path whose file has this name."""
    return files.filter(name_of(F.col("path")) == name).agg(F.min("path").alias("path"))


def pick_files(files: DataFrame) -> DataFrame:
    """One row ``schema_path, migration_path``: the first file named schema.sql, and the last other SQL file, those in a folder named after
    migrations before others. Null where there is none."""
    sql = files.filter(F.col("path").endswith(".sql") & ~ignored(F.col("path"))).select("path")
    schema = sql.filter(name_of(F.col("path")) == "schema.sql").agg(F.min("path").alias("schema_path"))
    rest = sql.join(schema, F.col("path") == F.col("schema_path"), "left_anti")
    folder = F.lower(F.element_at(F.concat(F.array(F.lit("")), F.split("path", "/")), -2))
    migration = rest.agg(F.max_by("path", F.struct(folder.contains("migration").cast("int"), F.col("path"))).alias("migration_path"))
    return schema.join(migration)


def pick_migration(files: DataFrame) -> DataFrame:
    """The migration of ``pick_files``."""
    return pick_files(files).select(F.col("migration_path").alias("path"))


def symbols_missing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Symbols (file, kind, name) of ``left`` that ``right`` lacks."""
    return left.join(right, ["file", "kind", "name"], "left_anti")


def unsafe(name: Column) -> Column:
    """Names of entries that would leave the folder they are put in."""
    plain = F.replace(name, F.lit("\\"), F.lit("/"))
    return (name == "") | plain.startswith("/") | plain.rlike("^[A-Za-z]:") | F.array_contains(F.split(plain, "/"), "..")


def archive_plan(entries: DataFrame, max_file: int = 20 * 2**20, max_total: int = 150 * 2**20, max_ratio: float = 200.0, ratio_from: int = 2**20, max_entries: int = 5000) -> DataFrame:
    """Adds ``total`` (bytes of files so far) and ``verdict`` to listings (archive, ordinal, name, is_dir, is_symlink, file_size, compress_size).

    A folder needs a safe path only.
    """
    from pyspark.sql import Window

    total = F.sum(F.when(F.col("is_dir"), 0).otherwise(F.col("file_size"))).over(Window.partitionBy("archive").orderBy("ordinal"))
    bomb = (F.col("file_size") >= ratio_from) & (F.col("compress_size") > 0) & (F.col("file_size") > max_ratio * F.col("compress_size"))
    count = F.col("ordinal") >= max_entries
    verdict = F.when(unsafe(F.col("name")), "UNSAFE_PATH").when(F.col("is_dir"), F.when(count, "TOO_MANY").otherwise("OK")).when(F.col("is_symlink"), "SYMLINK").when(count, "TOO_MANY").when(F.col("file_size") > max_file, "TOO_LARGE").when(bomb, "BOMB").when(total > max_total, "TOTAL").otherwise("OK")
    return entries.withColumn("total", total).withColumn("verdict", verdict)
