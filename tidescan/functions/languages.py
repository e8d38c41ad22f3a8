"""Language, framework and path classification as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of each language.
EXTENSIONS = {
    "python": [".py"], "javascript": [".js", ".mjs", ".cjs", ".jsx"], "typescript": [".ts", ".tsx"], "java": [".java"],
    "kotlin": [".kt"], "go": [".go"], "php": [".php"], "ruby": [".rb"], "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp"],
    "csharp": [".cs"], "rust": [".rs"], "swift": [".swift"], "bash": [".sh", ".bash", ".zsh"], "terraform": [".tf", ".tfvars"],
    "yaml": [".yaml", ".yml"], "json": [".json"], "xml": [".xml"], "html": [".html", ".htm"], "jinja2": [".jinja", ".jinja2", ".j2"],
    "twig": [".twig"], "erb": [".erb"], "ejs": [".ejs"], "handlebars": [".hbs"], "mustache": [".mustache"],
    "dockerfile": [".dockerfile"], "dotenv": [".env"], "ini": [".ini"], "toml": [".toml"], "properties": [".properties"],
}
CONFIG_EXTENSIONS = [".yaml", ".yml", ".json", ".xml", ".env", ".ini", ".toml", ".properties", ".tf", ".tfvars", ".dockerfile"]

# Other spellings of a language's name, as they occur in delivered tables.
LANGUAGE_ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "c#": "csharp", "golang": "go", "rb": "ruby", "sh": "bash", "yml": "yaml", "c++": "cpp"}

# Texts that betray a framework, by language.
FRAMEWORKS = {
    "python": {
        "flask": ["from flask import", "import flask", "Flask(__name__)", "@app.route"],
        "django": ["from django", "import django", "django.db", "INSTALLED_APPS"],
        "fastapi": ["from fastapi", "import fastapi", "FastAPI()", "@app.get", "@router.get"],
        "tornado": ["import tornado", "tornado.web"],
        "aiohttp": ["from aiohttp", "import aiohttp", "web.Application()"],
        "pyramid": ["from pyramid", "import pyramid"],
    },
    "javascript": {
        "express": ["require('express')", "from 'express'", "express()", "app.get(", "router.get("],
        "nextjs": ["from 'next'", "require('next')", "getServerSideProps", "getStaticProps"],
        "nestjs": ["@Module", "@Controller", "@Injectable", "from '@nestjs"],
        "koa": ["require('koa')", "from 'koa'", "new Koa()"],
        "hapi": ["require('@hapi/hapi')", "Hapi.server("],
        "react": ["from 'react'", "require('react')", "React.createElement", "useState", "useEffect"],
        "vue": ["from 'vue'", "createApp(", "Vue.component("],
    },
    "java": {
        "spring": ["@SpringBootApplication", "@RestController", "@Controller", "@Service", "@Repository", "import org.springframework"],
        "struts": ["import org.apache.struts", "ActionSupport"],
        "jersey": ["import javax.ws.rs", "import jakarta.ws.rs"],
        "dropwizard": ["io.dropwizard"],
        "servlet": ["HttpServlet", "HttpServletRequest", "doGet", "doPost"],
    },
    "php": {
        "laravel": ["use Illuminate", "App\\", "artisan", "Eloquent"],
        "symfony": ["use Symfony", "Symfony\\Component"],
        "wordpress": ["wp_query", "get_post", "add_action", "WP_"],
        "codeigniter": ["CI_Controller", "$this->load->model"],
    },
    "ruby": {
        "rails": ["Rails.application", "ActiveRecord::Base", "ActionController", "has_many", "belongs_to"],
        "sinatra": ["require 'sinatra'", "Sinatra::Base"],
    },
    "go": {
        "gin": ['"github.com/gin-gonic/gin"', "gin.Default()", "gin.New()"],
        "echo": ['"github.com/labstack/echo"', "echo.New()"],
        "fiber": ['"github.com/gofiber/fiber"', "fiber.New()"],
        "chi": ['"github.com/go-chi/chi"'],
        "gorilla": ['"github.com/gorilla/mux"'],
        "stdlib": ["net/http", "http.HandleFunc", "http.ServeMux"],
    },
}

# Directories that are never scanned.
SKIP_DIRS = [
    "node_modules", ".git", "vendor", "__pycache__", ".tox", "venv", ".venv", "env", ".env", "dist", "build", "target", ".gradle",
    ".mvn", "coverage", ".coverage", "htmlcov", ".pytest_cache", ".mypy_cache", "site-packages", "eggs", ".eggs", "migrations",
    "static", "assets", "public", "media", "uploads", ".idea", ".vscode", ".ds_store",
]
# Dependency manifests by name (a project file ending in .csproj is one too).
MANIFESTS = [
    "requirements.txt", "requirements-dev.txt", "requirements-prod.txt", "Pipfile", "Pipfile.lock", "pyproject.toml", "setup.py",
    "setup.cfg", "package.json", "pom.xml", "build.gradle", "build.gradle.kts", "go.mod", "Gemfile", "Gemfile.lock", "composer.json",
    "composer.lock", "Cargo.toml", "Cargo.lock", "packages.config", "paket.dependencies", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "poetry.lock", "go.sum",
]
# Ends of the names of generated files.
GENERATED_ENDS = [
    "bundle.js", "bundle.min.js", ".min.js", ".min.css", "package-lock.json", "yarn.lock", "poetry.lock", "pipfile.lock", ".pb.go",
    "_pb2.py", "_pb2_grpc.py",
]


def constant_map(pairs: dict[str, str]) -> Column:
    """A literal map, so that a lookup stays one small expression however many entries there are."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix in lower case with its dot, or ''. A name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def detect_language(path: Column) -> Column:
    """Language of a path: special names first, then the extension, else 'unknown'; null for null."""
    name = F.lower(base_name(path))
    ext = extension(path)
    out = (
        F.when(path.isNull(), None).when(name == "dockerfile", "dockerfile").when((name == ".env") | name.startswith(".env."), "dotenv")
        .when(name.isin("gemfile", "gemfile.lock"), "ruby").when(name.isin("makefile", "gnumakefile"), "make")
    )
    known = constant_map({end: language for language, ends in EXTENSIONS.items() for end in ends})
    return out.otherwise(F.coalesce(F.try_element_at(known, ext), F.lit("unknown")))


def canonical_language(name: Column) -> Column:
    """Delivered language names in one spelling; null stays null."""
    low = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(constant_map(LANGUAGE_ALIASES), low), low)


def iac_language(path: Column) -> Column:
    """Kind of an infrastructure file by the shape of its path, or null."""
    low = F.lower(path)
    name, ext = F.lower(base_name(path)), extension(path)
    dirs = F.split(low, "/")
    return (
        F.when((name == "dockerfile") | name.endswith(".dockerfile"), "dockerfile")
        .when(ext.isin(".tf", ".tfvars"), "terraform")
        .when(ext.isin(".yml", ".yaml") & low.contains(".github/workflows"), "github_actions")
        .when(ext.isin(".yml", ".yaml") & low.contains(".gitlab-ci"), "gitlab_ci")
        .when(ext.isin(".yml", ".yaml") & name.startswith("docker-compose"), "docker_compose")
        .when(ext.isin(".yml", ".yaml") & F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in ("k8s", "kubernetes", "manifests", "helm", "charts")])), "kubernetes")
    )


def rule_language(language: Column, known: list[str]) -> Column:
    """The rule set a language uses: its own, that of its kin, else the generic one."""
    kin = {"typescript": "javascript", "cpp": "c", "github_actions": "yaml", "gitlab_ci": "yaml", "docker_compose": "yaml", "kubernetes": "yaml"}
    return F.coalesce(F.try_element_at(constant_map(kin | {k: k for k in known}), language), F.lit("generic"))


def detect_frameworks(content: Column, language: Column) -> Column:
    """Sorted array of the frameworks whose texts occur; empty if none or the content is null."""
    hits = [
        F.when((language == lang) & F.greatest(*[content.contains(t) for t in texts], F.lit(False)), F.lit(name))
        for lang, frameworks in FRAMEWORKS.items()
        for name, texts in frameworks.items()
    ]
    return F.array_sort(F.array_compact(F.array(*hits)))


def parents(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def is_test(path: Column) -> Column:
    stem = F.regexp_replace(F.lower(base_name(path)), r"\.[^.]*$", "")
    dirs = F.array(*[F.lit(d) for d in ("test", "tests", "spec", "__tests__")])
    return F.arrays_overlap(F.split(F.lower(path), "/"), dirs) | stem.rlike(r"^(test|spec)_|_(test|spec)$|\.(test|spec)$")


def is_generated(path: Column) -> Column:
    name = F.lower(base_name(path))
    out = name.contains(".generated.")
    for end in GENERATED_ENDS:
        out = out | name.endswith(end)
    return out


def skipped(path: Column, more: list[str] | None = None) -> Column:
    """Whether a directory above a relative path is hidden, in the skip list or in ``more``."""
    names = SKIP_DIRS + [d.lower() for d in more or []]
    return F.exists(F.transform(parents(path), F.lower), lambda d: d.startswith(".") | d.isin(names))


def is_manifest(path: Column) -> Column:
    return base_name(path).isin(MANIFESTS) | F.lower(base_name(path)).endswith(".csproj")
