"""What kind of file a path is, and how much that says about what it holds."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


# Categories of files by extension, exact name (any case) and glob.
CATEGORIES: dict[str, dict[str, tuple[str, ...]]] = {
    "frontend": {"ext": _words("js mjs cjs jsx ts tsx vue svelte html htm xhtml ejs hbs handlebars pug jade css scss sass less astro"),
                 "glob": _words("chunk-*.js *.min.js *.bundle.js main.*.js app.*.js")},
    "sourcemap": {"ext": ("map",), "glob": _words("*.js.map *.css.map *.mjs.map")},
    "config": {"ext": _words("json json5 jsonc yaml yml xml toml ini conf config cfg properties plist reg env service timer socket netrc"),
               "name": _words(".env .netrc _netrc web.config app.config application.properties settings.py local_settings.py credentials config secrets.yaml secrets.yml"),
               "glob": _words(".env* *.env *rc *.conf.d/*")},
    "iac": {"ext": _words("tf tfvars tfstate hcl bicep"),
            "name": _words("values.yaml values.yml wrangler.toml serverless.yml serverless.yaml sam.yaml sam.yml template.yaml kustomization.yaml ansible.cfg inventory vault.yml"),
            "glob": _words("*.tfstate.backup k8s*.y*ml *.k8s.y*ml helm*.y*ml *playbook*.y*ml *.auto.tfvars")},
    "vcs": {"name": _words("config index COMMIT_EDITMSG HEAD packed-refs FETCH_HEAD ORIG_HEAD .gitignore .gitmodules .git-credentials entries wc.db hgrc dirstate"),
            "glob": _words(".git/* */.git/* .svn/* */.svn/* .hg/* */.hg/* .bzr/* */.bzr/*")},
    "ide": {"ext": _words("sublime-project sublime-workspace iml editorconfig"),
            "name": _words("settings.json launch.json tasks.json workspace.xml misc.xml dataSources.xml dataSources.local.xml webServers.xml .DS_Store Thumbs.db desktop.ini"),
            "glob": _words(".vscode/* */.vscode/* .idea/* */.idea/*")},
    "keys": {"ext": _words("pem key pkcs12 pfx p12 crt cer der jks keystore kdbx ovpn asc gpg ppk csr kubeconfig"),
             "name": _words("id_rsa id_dsa id_ecdsa id_ed25519 id_ed25519_sk authorized_keys known_hosts identity server.key privkey.pem kubeconfig .htpasswd shadow keyring"),
             "glob": _words("id_* *.pem .aws/* */.aws/* .azure/* */.azure/* .gcp/* */.gcp/* .ssh/* */.ssh/* .docker/config.json .kube/* */.kube/*")},
    "manifest": {"name": _words("package.json package-lock.json yarn.lock pnpm-lock.yaml .npmrc .yarnrc .yarnrc.yml requirements.txt Pipfile Pipfile.lock poetry.lock pyproject.toml setup.py "
                                "setup.cfg .pypirc pypirc composer.json composer.lock Gemfile Gemfile.lock go.mod go.sum Cargo.toml Cargo.lock Dockerfile Containerfile docker-compose.yml "
                                "docker-compose.yaml compose.yaml Makefile Jenkinsfile gradle.properties build.gradle pom.xml .gitlab-ci.yml .travis.yml cloudbuild.yaml"),
                 "glob": _words("requirements*.txt docker-compose.*.y*ml Dockerfile.* .github/workflows/*")},
    "dump": {"ext": _words("sql dump sqlite sqlite3 db db3 mdb accdb rdb bak old orig save swp swo swn core log out csv tsv ldf mdf"),
             "name": _words("access.log error.log debug.log dump.rdb npm-debug.log"), "glob": _words("*~ *.sql.gz *.bak.* *.log.[0-9]* core.[0-9]*")},
    "archive": {"ext": _words("zip tar gz tgz bz2 tbz2 xz txz 7z rar jar war ear apk aab ipa whl egg nupkg vsix crx asar deb rpm"), "glob": _words("*.tar.gz *.tar.bz2 *.tar.xz")},
    "apispec": {"ext": _words("graphql gql raml har"),
                "name": _words("swagger.json swagger.yaml swagger.yml openapi.json openapi.yaml openapi.yml schema.graphql insomnia.json api.json thunder-collection.json"),
                "glob": _words("*.postman_collection.json *.postman_environment.json *.postman_globals.json *openapi*.y*ml *swagger*.json *insomnia*.json")},
    "bytecode": {"ext": _words("class pyc pyo wasm dll exe so dylib node dex elf o a bin dat pdb")},
}
# What a category adds to the confidence of a finding.
WEIGHTS = {"keys": 0.25, "config": 0.2, "iac": 0.2, "vcs": 0.15, "apispec": 0.12, "dump": 0.12, "sourcemap": 0.1, "ide": 0.1, "manifest": 0.05, "frontend": 0.0, "archive": 0.0, "bytecode": 0.0}
# Media, fonts, office files and disk images, never opened.
DENIED_EXTENSIONS = _words("png jpg jpeg gif bmp ico icns tiff tif webp avif heic psd ai eps svgz mp3 wav flac ogg oga m4a aac opus mid mp4 mkv mov avi webm flv m4v "
                           "woff woff2 ttf otf eot pdf docx xlsx pptx odt ods iso img vmdk qcow2 dmg")
# Folders of downloaded or generated files, by name and by part of the path.
DENIED_FOLDERS = _words("node_modules bower_components vendor venv .venv env __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox site-packages dist-info .gradle .m2 .cargo .rustup .cache .npm "
                        ".yarn Pods .terraform .next .nuxt .svelte-kit .angular .parcel-cache coverage .nyc_output .DS_Store Trash .steam .wine")
DENIED_PARTS = _words("/go/pkg/mod /.cargo/registry /.rustup/toolchains /.gradle/caches /.m2/repository /.nuget/packages /.pub-cache /.cache/go-build /site-packages/")
# Folders of tests and examples.
TEST_FOLDERS = _words("test tests testing spec specs fixture fixtures example examples sample samples mock mocks __tests__ __mocks__ testdata e2e demo demos stub stubs")
TEST_FILE = r"(?i)[._-](?:test|spec|fixture|mock|example|sample)s?\.[a-z0-9]+$"
COMMENT_LINE = r"^\s*(?:#|//|\*|--|;|<!--)"


def glob_regex(pattern: str) -> str:
    """A shell glob as a regular expression the JVM reads alike."""
    return "^" + fnmatch.translate(pattern).replace("(?s:", "(?s:").removesuffix(r"\Z").removesuffix(r"\z") + "$"


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(posix(path), "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension without its dot; empty for names that begin with their only dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def _globs(path: Column, patterns: Sequence[str]) -> Column:
    """Whether any glob matches the whole path or the base name: one expression for all."""
    if not patterns:
        return F.lit(False)
    joined = "|".join(glob_regex(p) for p in patterns)
    return posix(path).rlike(joined) | base_name(path).rlike(joined)


def categories(path: Column) -> Column:
    """All categories of a path, sorted; an empty array if none, null for null."""
    base, ext = F.lower(base_name(path)), extension(path)
    found = []
    for name in sorted(CATEGORIES):
        spec = CATEGORIES[name]
        hit = ext.isin(*spec["ext"]) if spec.get("ext") else F.lit(False)
        if spec.get("name"):
            hit = hit | base.isin(*(n.lower() for n in spec["name"]))
        if spec.get("glob"):
            hit = hit | _globs(path, spec["glob"])
        if name == "config":
            hit = hit | F.startswith(base, F.lit(".env"))
        elif name == "vcs":
            hit = hit | posix(path).rlike(r"(?:^|/)\.git/")
        elif name == "sourcemap":
            hit = hit | base.rlike(r"\.(?:js|css)\.map$")
        elif name == "archive":
            hit = hit | base.rlike(r"\.(?:tar\.(?:gz|bz2|xz)|sql\.gz)$")
        found.append(F.when(hit, F.lit(name)))
    return F.when(path.isNotNull(), F.array_compact(F.array(*found)))


def boost(kinds: Column) -> Column:
    """The largest weight of an array of categories, 0 for none."""
    table = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    return F.coalesce(F.array_max(F.transform(kinds, lambda c: F.try_element_at(table, c))), F.lit(0.0))


def context_penalty(path: Column, line: Column) -> Column:
    """What test folders or files (0.2) and comment lines (0.1) take off a confidence."""
    p = F.lower(posix(path))
    test = F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, TEST_FOLDERS))) | base_name(p).rlike(TEST_FILE)
    comment = F.coalesce(line.rlike(COMMENT_LINE), F.lit(False))
    return F.least(F.lit(0.3), F.when(test, 0.2).otherwise(0.0) + F.when(comment, 0.1).otherwise(0.0))


def denied_folder(path: Column) -> Column:
    """Whether a path lies in a folder that scans skip."""
    p = posix(path)
    out = F.arrays_overlap(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))), F.array(*map(F.lit, DENIED_FOLDERS)))
    for part in DENIED_PARTS:
        out = out | F.contains(p, F.lit(part))
    return out


def allowed(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), only: Sequence[str] | None = None, scope_only: bool = False) -> Column:
    """Whether a path is to be opened: exclusions first, then inclusions, then categories or extensions."""
    if only is not None:
        rest = F.arrays_overlap(categories(path), F.array(*map(F.lit, only)))
    elif scope_only:
        rest = F.size(categories(path)) > 0
    else:
        rest = ~extension(path).isin(*DENIED_EXTENSIONS)
    return F.when(_globs(path, exclude), False).when(_globs(path, include), True).otherwise(rest)


def logical_root(path: Column) -> Column:
    return F.substring_index(path, "!/", 1)


def safe_name(name: Column) -> Column:
    """A member name without parts that leave its folder."""
    return F.array_join(F.filter(F.split(posix(name), "/"), lambda p: ~p.isin("", ".", "..")), "/")
