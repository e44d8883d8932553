"""Items from servers, as Python data sources: mailboxes and polled feed readers; and probes.

Connections are made in tasks. The functions that read a connection are separate from the data
sources, so that they can be tested with stand-ins.
"""

from __future__ import annotations

import datetime as dt
import email
import email.header
import email.policy
import imaplib
import json
import poplib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

MAIL = "protocol string, host string, mailbox string, uid string, sender string, subject string, text string, fetched_at timestamp"
ENTRY = "id long, author string, title string, url string, html string, created_on_time long"
NEWEST = 60


def plain_text(message: email.message.Message) -> str:
    """The first plain-text part of a mail, or its HTML where there is none."""
    part = message.get_body(("plain", "html")) if isinstance(message, email.message.EmailMessage) else None
    try:
        return "" if part is None else part.get_content()
    except (LookupError, ValueError):
        return part.get_payload(decode=True).decode("utf-8", "replace")


def _mail_row(protocol: str, host: str, mailbox: str, uid: str, raw: bytes, now: dt.datetime) -> tuple:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    return protocol, host, mailbox, uid, str(message.get("From", "")), str(message.get("Subject", "")), plain_text(message), now


def imap_search(query: str | None, since_days: int | None, today: dt.date) -> str:
    """Search terms: a given query, or mail since so many days."""
    if query:
        return query
    return f"(SINCE {(today - dt.timedelta(days=since_days)).strftime('%d-%b-%Y')})" if since_days else "ALL"


def read_imap(client, host: str, mailbox: str, search: str, now: dt.datetime, newest: int = NEWEST) -> Iterator[tuple]:
    """The newest mails that a search finds, without changing the mailbox."""
    client.select(mailbox, readonly=True)
    _, found = client.uid("SEARCH", None, search)
    for uid in (found[0] or b"").split()[-newest:]:
        _, parts = client.uid("FETCH", uid, "(BODY.PEEK[])")
        raw = next((p[1] for p in parts if isinstance(p, tuple)), None)
        if raw is not None:
            yield _mail_row("imap", host, mailbox, uid.decode(), raw, now)


def read_pop3(client, host: str, now: dt.datetime, newest: int = NEWEST) -> Iterator[tuple]:
    """The newest mails of a POP3 box, under their unique ids."""
    _, lines, _ = client.uidl()
    for line in lines[-newest:]:
        number, uid = line.decode().split(" ", 1)
        _, parts, _ = client.retr(int(number))
        yield _mail_row("pop3", host, "", uid, b"\r\n".join(parts), now)


class MailSource(DataSource):
    """Batch source `lantern_mail`: protocol (imap or pop3), host, user, password, mailbox, query, since_days."""

    @classmethod
    def name(cls) -> str:
        return "lantern_mail"

    def schema(self) -> str:
        return MAIL

    def reader(self, schema: StructType) -> DataSourceReader:
        return MailReader(dict(self.options))


class MailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        o, now = self.options, dt.datetime.now(dt.timezone.utc)
        if o.get("protocol", "imap") == "pop3":
            client = poplib.POP3_SSL(o["host"])
            client.user(o["user"])
            client.pass_(o["password"])
            yield from read_pop3(client, o["host"], now)
            client.quit()
        else:
            client = imaplib.IMAP4_SSL(o["host"])
            client.login(o["user"], o["password"])
            search = imap_search(o.get("query"), int(o.get("since_days", 0)), now.date())
            yield from read_imap(client, o["host"], o.get("mailbox", "INBOX"), search, now)
            client.logout()


def entries_after(payload: str, since: int) -> list[tuple]:
    """Entries of a feed reader's answer beyond an id, by id."""
    found = [e for e in json.loads(payload or "{}").get("items") or [] if int(e.get("id", 0)) > since]
    keys = ("id", "author", "title", "url", "html", "created_on_time")
    return [tuple(int(e.get(k) or 0) if k in ("id", "created_on_time") else e.get(k) for k in keys) for e in sorted(found, key=lambda e: int(e["id"]))]


class FeedApiSource(DataSource):
    """Streaming source `lantern_feed_api`: polls `url` (with `{since}` for the last id); its offset is that id."""

    @classmethod
    def name(cls) -> str:
        return "lantern_feed_api"

    def schema(self) -> str:
        return ENTRY

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return FeedApiReader(dict(self.options))


class FeedApiReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.timeout = options["url"], float(options.get("timeout", 30))

    def initialOffset(self) -> dict:
        return {"id": 0}

    def _fetch(self, since: int) -> list[tuple]:
        with urllib.request.urlopen(self.url.replace("{since}", str(since)), timeout=self.timeout) as answer:
            return entries_after(answer.read().decode("utf-8"), since)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._fetch(start["id"])
        return iter(rows), {"id": rows[-1][0] if rows else start["id"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for r in self._fetch(start["id"]) if r[0] <= end["id"]])


def recent_messages(messages: Iterable, since: dt.datetime, limit: int = 100) -> list:
    """Of messages from new to old (with `date`), those up to the first older one, at most `limit`."""
    out = []
    for message in messages:
        if message.date < since or len(out) >= limit:
            break
        out.append(message)
    return out


def fetch_with_retries(fetch: Callable[[], tuple[int, bytes]], refresh: Callable[[], None], sleep: Callable[[float], None] = time.sleep, tries: int = 3) -> bytes:
    """Repeat a request on passing errors, waiting 2, 4, 8 seconds, and once after new credentials on 401."""
    refreshed = False
    for attempt in range(tries + 1):
        status, body = fetch()
        if status == 401 and not refreshed:
            refreshed = True
            refresh()
            status, body = fetch()
        if status < 300:
            return body
        if status not in (408, 429, 502, 503, 504) or attempt == tries:
            raise OSError(f"HTTP {status}")
        sleep(2.0 * 2**attempt)
    raise AssertionError("unreachable")


def probe(url: str, timeout: float = 8.0, first: int = 2048) -> tuple[str, str, str]:
    """(status, content type, first bytes as text): HTTP errors are data, other failures have status `err`."""
    request = urllib.request.Request(url, headers={"User-Agent": "lantern-probe"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return str(getattr(answer, "status", None) or 200), answer.headers.get("Content-Type", ""), answer.read(first).decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return str(error.code), error.headers.get("Content-Type", "") if error.headers else "", error.read(first).decode("utf-8", "replace")
    except (OSError, ValueError) as error:
        return "err", f"{type(error).__name__}: {error}"[:120], ""


def probed(feeds: DataFrame, timeout: float = 8.0) -> DataFrame:
    """`feeds` (with url) and status, content_type, body of each; probes run in the tasks."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            found = [probe(u, timeout) for u in batch["url"]]
            yield batch.assign(status=[f[0] for f in found], content_type=[f[1] for f in found], body=[f[2] for f in found])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in feeds.schema)
    return feeds.mapInPandas(run, f"{kinds}, status string, content_type string, body string")


def service_status(status: str, detail: str) -> tuple[str, str]:
    """(up, degraded or down; detail) of a health probe."""
    if status == "err":
        return "down", detail[:120]
    return ("up", "") if status.startswith("2") else ("degraded", status)


def licensed(accepted: str | None) -> bool:
    """Whether a source that needs its licence accepted may be read."""
    return (accepted or "").strip().lower() in ("1", "true", "yes")
