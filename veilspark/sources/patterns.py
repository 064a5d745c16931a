"""Catalog of service key patterns, built in or read from JSON."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyPattern:
    service: str
    pattern: str
    description: str
    confidence: float = 0.90
    #: A text that every match contains, by which most texts are ruled out; empty if there is none.
    needs: str = ""


# fixed values: formats of service keys, first match of a service wins
BUILT_IN: tuple[KeyPattern, ...] = (
    KeyPattern("AWS", r"AKIA[0-9A-Z]{16}", "AWS Access Key ID", 0.95, "AKIA"),
    KeyPattern("AWS", r"(?i)aws.{0,20}['\"][0-9a-zA-Z/+]{40}['\"]", "AWS Secret Access Key", 0.90),
    KeyPattern("GitHub", r"ghp_[0-9a-zA-Z]{36}", "GitHub Personal Access Token", 0.98, "ghp_"),
    KeyPattern("GitHub", r"gho_[0-9a-zA-Z]{36}", "GitHub OAuth Token", 0.98, "gho_"),
    KeyPattern("GitHub", r"ghs_[0-9a-zA-Z]{36}", "GitHub App Token", 0.98, "ghs_"),
    KeyPattern("GitHub", r"github_pat_[0-9a-zA-Z_]{82}", "GitHub Fine-grained PAT", 0.99, "github_pat_"),
    KeyPattern("Stripe", r"sk_live_[0-9a-zA-Z]{24,}", "Stripe Live Secret Key", 0.99, "sk_live_"),
    KeyPattern("Stripe", r"sk_test_[0-9a-zA-Z]{24,}", "Stripe Test Secret Key", 0.95, "sk_test_"),
    KeyPattern("Stripe", r"rk_live_[0-9a-zA-Z]{24,}", "Stripe Restricted Key (live)", 0.99, "rk_live_"),
    KeyPattern("OpenAI", r"sk-[0-9a-zA-Z]{48}", "OpenAI API Key", 0.90, "sk-"),
    KeyPattern("OpenAI", r"sk-proj-[0-9a-zA-Z\-_]{80,}", "OpenAI Project API Key", 0.95, "sk-proj-"),
    KeyPattern("Anthropic", r"sk-ant-[0-9a-zA-Z\-_]{80,}", "Anthropic API Key", 0.99, "sk-ant-"),
    KeyPattern("Google", r"AIza[0-9A-Za-z\-_]{35}", "Google API Key", 0.95, "AIza"),
    KeyPattern("Google", r"[0-9]+-[0-9A-Za-z_]{32}\.apps\.googleusercontent\.com", "Google OAuth Client ID", 0.95, ".apps.googleusercontent.com"),
    KeyPattern("Slack", r"xoxb-[0-9]{11}-[0-9]{11}-[0-9a-zA-Z]{24}", "Slack Bot Token", 0.99, "xoxb-"),
    KeyPattern("Slack", r"xoxp-[0-9]{11}-[0-9]{11}-[0-9]{11}-[0-9a-zA-Z]{32}", "Slack User Token", 0.99, "xoxp-"),
    KeyPattern("Slack", r"xapp-[0-9]-[A-Z0-9]{10}-[0-9]{11}-[0-9a-f]{64}", "Slack App Token", 0.99, "xapp-"),
    KeyPattern("Twilio", r"AC[0-9a-fA-F]{32}", "Twilio Account SID", 0.90, "AC"),
    KeyPattern("Twilio", r"SK[0-9a-fA-F]{32}", "Twilio API Key SID", 0.90, "SK"),
    KeyPattern("SendGrid", r"SG\.[0-9a-zA-Z\-_]{22}\.[0-9a-zA-Z\-_]{43}", "SendGrid API Key", 0.99, "SG."),
    KeyPattern("Cloudflare", r"[0-9a-f]{37}", "Cloudflare API Token (length heuristic)", 0.60),
    KeyPattern("DigitalOcean", r"dop_v1_[0-9a-f]{64}", "DigitalOcean Personal Access Token", 0.99, "dop_v1_"),
    KeyPattern("Heroku", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "Heroku API Key (UUID format)", 0.70),
    KeyPattern("NPM", r"npm_[0-9a-zA-Z]{36}", "NPM Access Token", 0.99, "npm_"),
    KeyPattern("Discord", r"[MN][A-Za-z\d]{23}\.[\w-]{6}\.[\w-]{27}", "Discord Bot Token", 0.95),
)


def usable(spark, catalog: tuple[KeyPattern, ...]) -> tuple[KeyPattern, ...]:
    """The patterns that compile; others are named in a warning and left out."""
    good = []
    for p in catalog:
        try:
            spark.range(1).select(F.lit("").rlike(p.pattern)).collect()
        except Exception:  # noqa: BLE001 - a pattern that the engine refuses, whatever it says
            logging.getLogger(__name__).warning("pattern of %s skipped: %s", p.service, p.pattern)
        else:
            good.append(p)
    return tuple(good)


def read_json(spark, path: str) -> tuple[KeyPattern, ...]:
    """Catalog from a JSON object of service to list of patterns; keys that start with ``_`` are notes.

    A missing file is an empty catalog.
    """
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return ()
        raise
    out = []
    for service, entries in json.loads(rows[0][0]).items():
        if not service.startswith("_"):
            out += [KeyPattern(service, e["pattern"], e.get("description", service), float(e.get("confidence", 0.90))) for e in entries]
    return usable(spark, tuple(out))
