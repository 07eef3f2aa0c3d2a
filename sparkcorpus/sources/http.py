"""Fetching over HTTP, as the fetcher of site maps and article pages."""

from __future__ import annotations

import urllib.error
import urllib.request

from sparkcorpus.sources.sitemap import TooManyRequests


class Fetcher:
    """``fetcher(url)`` gives a page's text. A request to slow down is ``TooManyRequests``; a missing page, and one that is refused, is a ``ValueError``."""

    def __init__(self, timeout: float = 30.0, agent: str = "sparkcorpus"):
        self.timeout, self.agent = timeout, agent

    def __call__(self, url: str) -> str:
        if not url.lower().startswith(("http://", "https://")):
            raise ValueError(f"no web address: {url}")
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as answer:  # noqa: S310
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise TooManyRequests(url) from e
            if e.code >= 500:
                raise ConnectionError(f"{url}: {e.code}") from e
            raise ValueError(f"{url}: {e.code}") from e
