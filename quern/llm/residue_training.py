"""Training of the template classifier.

``python -m quern.llm.residue_training PAGES.parquet ASSETS.parquet ...`` (pairs); with
``--held-out N`` in front it only reports: every Nth kind of site is left out of
training and the disagreement on its lines is printed.  Lines are labelled by the
annotation rules below, at most ``MAX_LINES`` of each pair of tables (in order of id),
and the standard messages beside them count as residue.  No whole line is a feature.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter

import numpy as np

from quern.llm.page_training import labelled
from quern.llm.residue import MENTION, MODEL, SLOT, Scorer, made_up, template_features, units
from quern.llm.visual_form import visual_key

MAX_LINES = 600_000
#: Messages that web servers, gateways, frameworks and page builders show as they come; filler of typesetters.
STANDARD = [
    "Just a moment...", "Checking your browser before accessing the site.", "This process is automatic.", "Your browser will redirect to your requested content shortly.",
    "Please allow up to 5 seconds", "Verify you are human by completing the action below.", "Please complete the security check to access the site.", "Please stand by, while we are checking your browser...",
    "Enable JavaScript and cookies to continue", "Please enable JavaScript to continue.", "Please enable cookies.", "You need to enable JavaScript to run this app.",
    "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.", "This page requires JavaScript.", "JavaScript is disabled in your browser.",
    "JavaScript seems to be disabled in your browser.", "For the best experience on our site, be sure to turn on Javascript in your browser.", "Your browser does not support JavaScript!", "Please turn on JavaScript in your browser and reload the page.",
    "This site requires cookies to be enabled.", "Your browser does not support the video tag.", "You need a PDF viewer to open this file.", "Under construction", "This page is under construction.", "Site under maintenance",
    "We are currently performing scheduled maintenance.", "We'll be back soon!", "Down for maintenance", "Coming soon", "Content coming soon.", "More information to follow.", "TBD", "To be announced", "Nothing here yet.",
    "404 Not Found", "404 Page not found", "Page not found", "The page you are looking for could not be found.", "The page you requested was not found.", "Sorry, this page isn't available.", "Oops! That page can't be found.",
    "The requested URL was not found on this server.", "403 Forbidden", "You don't have permission to access this resource.", "Access Denied", "You do not have permission to view this page.", "401 Unauthorized",
    "500 Internal Server Error", "Internal Server Error", "The server encountered an internal error or misconfiguration and was unable to complete your request.", "502 Bad Gateway", "503 Service Unavailable",
    "The service is temporarily unavailable.", "504 Gateway Time-out", "This site can't be reached", "The connection has timed out", "The server is taking too long to respond.", "Error establishing a database connection",
    "Something went wrong. Please try again later.", "An unexpected error has occurred.", "Too many requests", "Your session has expired. Please log in again.", "Please log in to view this page.", "Invalid request.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.", "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Sample text. Click to select the text box.", "Add your text here.", "Enter text here", "Your content goes here.", "Insert text here", "Hello world!", "Welcome to WordPress. This is your first post. Edit or delete it, then start writing!",
    "페이지를 찾을 수 없습니다.", "요청하신 페이지가 존재하지 않습니다.", "서비스 점검 중입니다.", "시스템 점검 안내", "잘못된 접근입니다.", "접근 권한이 없습니다.", "로그인이 필요한 서비스입니다.", "일시적인 오류가 발생했습니다.", "잠시 후 다시 시도해 주세요.",
    "자바스크립트를 사용할 수 없습니다.", "브라우저의 자바스크립트 설정을 확인해 주세요.", "페이지 준비 중입니다.", "내용을 입력해 주세요.", "등록된 게시물이 없습니다.", "서버에 연결할 수 없습니다.",
]
#: Annotation rules: a whole line that is a message, filler or try-out text.
MESSAGE = re.compile("|".join([
    r"찾을 수 없습니다\.?$|(?:접근|보기) 권한(?:이 없|을 확인)|접근할 수 없습니다|불러오기에 실패|제공이 끝났습니다|비공개 글입니다|삭제된 게시물|존재하지 않는|처리 시간이 초과",
    r"세션이 만료|처리 중 오류가 발생|연결에 실패하였|점검 중으로 이용|접속이 원활하지|불편을 드려 죄송|^오류 코드|^\[\d+\] 안내|^추적 코드|^요청 번호|^새로고침$|^이전 화면으로$",
    r"스크립트를 지원하지|자바스크립트를 켜야|스크립트 실행이 꺼져|스크립트 차단을 해제|뷰어 프로그램을 설치|^설정 방법 안내$|^지원 브라우저",
    r"^제목 없음$|곧 등록됩니다\.?$|^작성 예정$|^준비 중입니다|내용을 입력하세요\.|본문 예시 문장입니다|글이 놓이는 자리입니다",
    r"^(?:http|error|error code) ?\d+$|^\d+ error$|^ref#|^request id|bad gateway|service unavailable|internal error has|session has timed out|access denied|requested resource is gone",
    r"^(?:the|that|this) (?:\w+) (?:could not be|is restricted|does not exist|is no longer|took too long|was not|has been|cannot be)|go back to the start page|^at [\w.]+\([\w.]+:\d+\)$",
    r"allow scripts and cookies|requires scripts to run|turn on javascript|^supported browsers|^\(noscript\)$|^untitled page$|^coming soon|^to be written",
    r"sample text goes here|insert your paragraph|replace this copy before|^lorem ipsum|ipsum dolor",
    r"^(?:[ㄱ-ㅎ]+|asdf|qwer|zxcv|test|테스트|시험|\d+)(?: (?:[ㄱ-ㅎ]+|asdf|qwer|zxcv|test\d*|테스트|등록 확인))+$|^[ㄱ-ㅎ]{3,}$|^(?:zxcv)+$|^\.{4,}$|^(?:가나다라마바사아자차카타파하)+$|^aaaaa( bbbbb)+",
]))


def label(line: str) -> int:
    s = re.sub(r"\s+", " ", visual_key(line)).strip().lower()
    if SLOT.search(visual_key(line)):
        return int(not MENTION.search(s))
    if made_up(s) or all(made_up(x) for x in re.split(r"(?<=[.]) ", s)):
        return 1
    return int(bool(MESSAGE.search(s)) and len(s) < 90 or bool(re.match(r"(.{6,60}?[.]) ?\1", s)))


def lines_of(pages, assets):
    for text, title in pages:
        for line, is_title, _, y in labelled(text, title):
            if not is_title:
                yield line, y
    for text in assets:
        for line in text.split("\n"):
            yield line, 1


def labelled_units(line: str, own: int):
    """Masked units of a line with their labels.  A sentence of running text is residue only if most of its line is:
    a notice may write about a message."""
    got = [(m, n) for m, n, _ in units(line) if m and "<slot>" not in m]
    if len(got) == 1:
        yield got[0][0], label(line) if own else 0
        return
    parts = [p for p in re.split(r"(?<=[.!?])\s+|(?<=다\.)", re.sub(r"\s+", " ", visual_key(line)).strip()) if p]
    bad = sum(len(p) for p in parts if label(p)) if own else 0
    for m, _ in got:
        yield m, int(bad > 0.5 * sum(map(len, parts)))


def train(rows: Counter) -> dict[str, float]:
    for text in STANDARD:
        for m, _, _ in units(text):
            if m and (m, 0) not in rows:
                rows[m, 1] += 3
    data = [(template_features(m), y, min(n, 20)) for (m, y), n in sorted(rows.items())]
    counts: Counter = Counter()
    for f, y, _ in data:
        counts.update(dict.fromkeys(f, 1 + y))
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 2))}
    w, g2 = np.zeros(len(index)), np.full(len(index), 1e-6)
    idx = [np.array([index[x] for x in f if x in index]) for f, *_ in data]
    ys, ns = [y for _, y, _ in data], [n ** 0.5 * (3 if y else 1) for _, y, n in data]
    rng = np.random.default_rng(1)
    # Ordinary templates are many: each pass takes all residue and as many others as ten times that, the next ones each time.
    bad, good = [i for i, y in enumerate(ys) if y], rng.permutation([i for i, y in enumerate(ys) if not y])
    at = 0
    for turn in range(30):
        part = np.take(good, range(at, at + min(len(good), max(10 * len(bad), 30_000))), mode="wrap")
        at += len(part)
        if turn % 5 == 4:  # and those it takes for residue so far
            part = np.concatenate([part, [i for i in good if w[idx[i]].sum() > -1]])
        for i in rng.permutation(np.concatenate([bad, part]).astype(int)):
            x = idx[i][rng.random(len(idx[i])) < 0.75]
            g = (1 / (1 + np.exp(-np.clip(w[x].sum(), -30, 30))) - ys[i]) * ns[i] + 1e-5 * w[x]
            g2[x] += g * g
            w[x] -= 0.2 * g / np.sqrt(g2[x])
    keep = sorted(range(len(w)), key=lambda i: -abs(w[i]))
    names = list(index)
    return {names[i]: round(float(w[i]), 2) for i in keep[:8000] if abs(w[i]) >= 0.1}


def main(paths: list[str]) -> None:
    import pandas as pd

    hold = int(paths[1]) if paths[0] == "--held-out" else 0
    paths = paths[2:] if hold else paths
    rows: Counter = Counter()
    left_out: Counter = Counter()
    for docs, assets in zip(paths[::2], paths[1::2]):
        d = pd.read_parquet(docs, columns=["doc_id", "raw_text", "title", "source_type"]).sort_values("doc_id")
        kinds = set(sorted(d.source_type.unique())[::hold]) if hold else set()
        a = pd.read_parquet(assets, columns=["id", "doc_id", "extracted_text"]).sort_values("id")
        a = a[a.extracted_text.notna()]
        away = set(d[d.source_type.isin(kinds)].doc_id)
        d = d[d.raw_text.notna()]
        for into, dd, aa in ((rows, d[~d.doc_id.isin(away)], a[~a.doc_id.isin(away)]), (left_out, d[d.doc_id.isin(away)], a[a.doc_id.isin(away)])):
            for n, (line, own) in enumerate(lines_of(zip(dd.raw_text, dd.title), aa.extracted_text)):
                if n >= MAX_LINES:
                    break
                for unit, y in labelled_units(line, own):
                    into[unit, y] += 1
    weights = train(rows)
    scorer = Scorer(weights)
    test = left_out if hold else rows
    hits = Counter()
    bad = Counter()
    for (m, y), n in test.items():
        p = scorer(m) >= 0.5
        hits[y, p] += n
        if p != bool(y):
            bad[m, y] += n
    print("held-out kinds of site" if hold else "training lines", dict(hits), "recall", round(hits[1, True] / max(1, hits[1, True] + hits[1, False]), 5),
          "precision", round(hits[1, True] / max(1, hits[1, True] + hits[0, True]), 5), bad.most_common(25))
    if not hold:
        MODEL.write_text(json.dumps(weights, ensure_ascii=False, indent=0, sort_keys=True), encoding="utf-8")


if __name__ == "__main__":
    main(sys.argv[1:])
