"""Ready-made profiles for the files of well-known programs, by name."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from ..operators.fields import FieldRule
from ..operators.profiles import Profile

_PASS, _TOKEN = "custom:password", "auth_token"


def _rules(prefix: str, **by_category: str) -> tuple[FieldRule, ...]:
    """Field rules from globs by category, apart by spaces; keywords stand for categories."""
    names = {"passwords": _PASS, "tokens": _TOKEN, "users": "name", "hosts": "hostname", "urls": "url", "emails": "email", "paths": "file_path", "bodies": "custom:body", "addresses": "ipv4", "arns": "aws_arn", "accounts": "custom:account"}
    return tuple(FieldRule(g, names[kind], f"{prefix}_{re.sub(r'[^a-z0-9]+', '_', g.lower()).strip('_')}", min_length=1) for kind, globs in by_category.items() for g in globs.split())


def _yaml(prefix: str, include: str = "", **kinds: str) -> Profile:
    return Profile("yaml", (".yaml", ".yml"), _rules(prefix, **kinds), include=tuple(include.split()))


def _json(prefix: str, include: str = "", ends: str = ".json", **kinds: str) -> Profile:
    return Profile("json", tuple(ends.split()), _rules(prefix, **kinds), include=tuple(include.split()))


def _env(prefix: str, **kinds: str) -> Profile:
    return Profile("env", (".env", ".env.local", ".env.production", ".env.staging", ".env.development", ".env.test"), _rules(prefix, **kinds))


def _lines(prefix: str, ends: str, include: str = "", options: dict | None = None, **kinds: str) -> Profile:
    return Profile("key_value", tuple(ends.split()) or ("",), _rules(prefix, **kinds), include=tuple(include.split()), options=options or {})


BUNDLES: dict[str, tuple[Profile, ...]] = {
    "ansible": (_yaml("ansible", "group_vars/**/*.yml group_vars/**/*.yaml host_vars/**/*.yml host_vars/**/*.yaml vars/main.yml defaults/main.yml", passwords="*password* *_pass", tokens="*token* *secret* *api_key*", users="ansible_user *_username", hosts="ansible_host"),),
    "aws-cli": (_lines("aws", "", ".aws/credentials .aws/config aws/credentials aws/config", tokens="aws_access_key_id aws_secret_access_key aws_session_token", arns="role_arn", urls="sso_start_url", accounts="sso_account_id"),),
    "bruno": (_lines("bruno", ".bru", options={"delimiter": ":"}, tokens="token *api_key* *secret*", passwords="password", users="username", urls="url"),),
    "circleci": (_yaml("circleci", ".circleci/*.yml .circleci/*.yaml", tokens="jobs.*.environment.* executors.*.environment.*"),),
    "datadog": (_yaml("datadog", "datadog.yaml **/datadog.yaml **/conf.d/**/*.yaml", tokens="api_key app_key *.api_key *token*", passwords="*password*", hosts="site hostname *.host", users="*.username"),),
    "dataiku": (_json("dataiku", "connections.json **/connections.json users.json **/users.json general-settings.json", passwords="*password* *passphrase*", tokens="*secret* *token* *apiKey*", users="*.login *.user", hosts="*.host", emails="*.email"),),
    "django": (_env("django", tokens="SECRET_KEY", passwords="*PASSWORD*", users="*_USER", hosts="*_HOST", urls="DATABASE_URL CACHE_URL SENTRY_DSN"),),
    "docker-compose": (_yaml("compose", "docker-compose*.yml docker-compose*.yaml compose.yml compose.yaml", passwords="*PASSWORD*", tokens="*SECRET* *TOKEN* *API_KEY*", users="*_USER", urls="*_URL"),),
    "elasticsearch": (_yaml("es", "elasticsearch.yml elasticsearch.yaml", passwords="*secure_password *.password", hosts="network.host cluster.name node.name", tokens="*secret*"),),
    "fstab": (),
    "github-actions": (_yaml("gha", ".github/workflows/**/*.yml .github/workflows/**/*.yaml", tokens="env.* jobs.*.env.* jobs.*.steps.*.env.*", passwords="*.password"),),
    "gitlab": (
        _lines("gitlab", ".rb", "gitlab.rb **/gitlab.rb", {"secondary_delimiters": ("=>", ":")}, passwords="*password*", tokens="*secret* *token* *key*", urls="external_url *_url", hosts="*_host *_address", users="*user_name *bind_dn"),
        Profile("jsonl", (".json", ".log"), _rules("gitlab", users="username user meta.user", addresses="remote_ip ip meta.remote_ip", paths="path", urls="uri", tokens="*token*"), include=("production_json.log", "api_json.log", "audit_json.log", "sidekiq/current", "application_json.log", "auth_json.log", "exceptions_json.log", "integrations_json.log")),
        _yaml("gitlab", "secrets.yml database.yml gitlab.yml", tokens="*key_base *token* *secret*", passwords="*password*", hosts="*.host"),
        Profile("json", (".json",), _rules("gitlab", tokens="*secret* *token* *key*", passwords="*password*"), include=("gitlab-secrets.json",)),
    ),
    "grafana": (_lines("grafana", ".ini .conf", "grafana.ini grafana.conf defaults.ini", {"comment_prefix": ";"}, tokens="secret_key *client_secret *token*", passwords="*password*", users="*user", hosts="domain host"),),
    "har": (_json("har", ends=".har", urls="log.entries.request.url log.entries.response.redirectURL", tokens="*.cookies.value *.headers.value *.queryString.value", bodies="*.postData.text *.content.text", addresses="*.serverIPAddress"),),
    "heroku": (_json("heroku", "app.json", tokens="env.*.value env.*.default"), _env("heroku", tokens="*KEY* *TOKEN* *SECRET*", passwords="*PASSWORD*", urls="*_URL")),
    "insomnia": (_json("insomnia", "insomnia*.json Insomnia_*.json *.insomnia.json", urls="resources.url", bodies="resources.body.text", tokens="*.authentication.token *.headers.value", passwords="*.authentication.password", users="*.authentication.username"),),
    "kubernetes": (
        Profile("yaml", (".yaml", ".yml", "config", "kubeconfig"), _rules("k8s", tokens="*.user.token *.user.client-key-data *.user.client-certificate-data *.certificate-authority-data", urls="*.cluster.server", passwords="*.user.password", users="*.user.username"), include=("kubeconfig", "*.kubeconfig", "config", "kube-config.yaml", "kube-config.yml")),
        Profile("yaml", (".yaml", ".yml"), (*_rules("k8s", tokens="data.* stringData.*", hosts="spec.rules.host spec.tls.hosts"), FieldRule("data.*.conf", _TOKEN, "k8s_embedded", sub_processor="ini", sub_rules=(FieldRule("*password*", _PASS),))), include=("*secret*.yaml", "*secret*.yml")),
    ),
    "laravel": (_env("laravel", tokens="APP_KEY *SECRET* *TOKEN*", passwords="*PASSWORD*", users="*USERNAME", hosts="*_HOST", urls="APP_URL"),),
    "mongodb": (Profile("yaml", (".conf", ".yaml", ".yml"), _rules("mongo", passwords="net.tls.certificateKeyFilePassword security.kmip.clientCertificatePassword *.password", paths="security.keyFile net.tls.certificateKeyFile", addresses="net.bindIp"), include=("mongod.conf", "mongos.conf", "mongodb.conf")),),
    "mysql": (_lines("mysql", ".cnf .ini", "my.cnf .my.cnf mysql.cnf my.ini mariadb.cnf", passwords="password *_password", users="user", hosts="host bind-address", paths="ssl-key ssl-cert ssl-ca"),),
    "nginx": (_lines("nginx", " .conf", "nginx.conf **/nginx.conf conf.d/*.conf sites-available/* sites-enabled/* snippets/*.conf", {"delimiter": " ", "value_strip_suffix": ";"}, hosts="server_name", urls="proxy_pass", paths="ssl_certificate ssl_certificate_key auth_basic_user_file"),),
    "postgresql": (
        _lines("pg", ".conf", "postgresql.conf pg_ident.conf", passwords="*password*", paths="ssl_cert_file ssl_key_file ssl_ca_file", urls="primary_conninfo"),
        Profile("csv", (".pgpass",), _rules("pgpass", hosts="0", users="3", passwords="4"), options={"delimiter": ":", "has_header": False}),
    ),
    "postman": (_json("postman", "*.postman_collection.json *.postman_environment.json postman_collection.json", tokens="*.auth.*.value *.header.value values.value", bodies="*.request.body.raw", urls="*.request.url.raw"),),
    "rails": (_yaml("rails", "database.yml database.yaml secrets.yml credentials.yml", passwords="*.password", users="*.username", hosts="*.host", urls="*.url", tokens="*secret_key_base *token* *api_key*"), _env("rails", tokens="SECRET_KEY_BASE RAILS_MASTER_KEY", urls="DATABASE_URL REDIS_URL")),
    "redis": (_lines("redis", ".conf", "redis.conf redis-*.conf sentinel.conf redis-sentinel.conf redis-server.conf", {"delimiter": " "}, passwords="requirepass masterauth", users="masteruser", addresses="bind", paths="tls-key-file tls-cert-file"),),
    "splunk": (_lines("splunk", ".conf", "outputs.conf inputs.conf authentication.conf passwords.conf server.conf alert_actions.conf **/local/*.conf", passwords="*password* sslPassword pass4SymmKey bindDNpassword", hosts="host server", users="bindDN auth_username"),),
    "spring-boot": (
        _yaml("spring", "application*.yaml application*.yml bootstrap.yaml bootstrap.yml", passwords="*.password", users="*.username", urls="*.url *.uri", tokens="*secret* *token* *api-key*", hosts="*.host"),
        _lines("spring", ".properties", "application*.properties bootstrap.properties", passwords="*.password", users="*.username", urls="*.url *.uri", tokens="*secret* *token*"),
    ),
    "terraform": (_lines("tf", ".tfvars", "", passwords="*password*", tokens="*secret* *_token *api_key* *access_key*", arns="*_arn"), _json("tf", "terraform.tfstate *.tfstate", ".tfstate", passwords="*password*", tokens="*secret* *token* *private_key*", arns="*.arn", addresses="*_ip")),
}
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*\Z")


def resolve(names: Sequence[str], own: Mapping[str, Sequence[Profile]] | None = None) -> list[Profile]:
    """The profiles of bundles by name, in order; own ones (a user's) come before those built in. An unknown or odd name raises ValueError."""
    out: list[Profile] = []
    for name in names:
        if not _NAME.match(name):
            raise ValueError("a bundle's name has letters, digits, _ and - only and begins with a letter or digit")
        found = (own or {}).get(name, BUNDLES.get(name))
        if found is None:
            raise ValueError(f"unknown bundle {name!r}; there are {', '.join(sorted({*BUNDLES, *(own or {})}))}")
        out += found
    return out
