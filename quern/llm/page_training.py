"""Training of the page model from labelled pages.

Run as ``python -m quern.llm.page_training PAGES.parquet...``; with ``--held-out N``
in front it only reports: every Nth kind of site is left out of training and the
model's errors on the pages of those kinds are printed.  Pages are labelled by the
annotation rules below, which name what stands around a notice on the boards at
hand; the model learns words, word pairs, shapes, the endings of titles and the
coupling of lines from at most ``MAX_PAGES`` labelled pages (in order of id).  No
whole line and no word with the site's own name is a feature.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter

import numpy as np

from quern.llm.page_model import _EDGE, MODEL, PageModel, features, tail
from quern.llm.visual_form import visual_key

MAX_PAGES = 20_000
#: Names of the site are no features; endings that this share of the titles have are known as such.
SITE_NAMES, TAIL_SHARE = ("nurisol", "누리솔"), 0.01
_ITEMS = ("통합검색|학교안내|교육과정|열린광장|로그인|입학정보|즐겨찾기|사이트맵|회원정보|학사정보|연구활동|정보마당|빠른서비스|대학생활|발전기금|"
          "research|visitors|site map|quick links|news room|sign in|giving|campus life|academics|directory|about nurisol|admissions")
_SITE = "(?:학사|취업|도서관|생활관|누리솔|입학|장학|전산|시설|공지|대학원|학생지원|국제|연구|international|research)"
#: Annotation rules: what stands around the notice.
RULES = [re.compile(p) for p in (
    rf"^(?:{_ITEMS})(?: \| (?:{_ITEMS}))*$",
    "관련 기관 바로가기 선택|전자우편 주소의 무단 수집|주메뉴로 바로 이동|주소 복사하여 공유|글자 크기 크게|본문으로 건너뛰기|copyright nurisol",
    "이 글이 도움이 되었나요|방문 통계 수집에 동의|화면 인쇄 및 파일 저장|쿠키 사용에 동의",
    f"{_SITE} 게시물의 무단 옮김과|본 {_SITE} 안내는 사정에|이 {_SITE} 글을 친구에게|{_SITE} 소식 받아보기|저작권은 누리솔대학교",
    f"{_SITE} 전체메뉴|{_SITE} 첫화면으로|누리솔대학교 {_SITE} 건물|{_SITE} 개인정보 처리방침|{_SITE} 누리집에 오신",
    f"{_SITE} 소식지 기자단|{_SITE} 개인정보 설정 관리|{_SITE} 누리집은 접속 유지",
    "^(?:최근 게시물|관련 글 목록|많이 본 글|주간 인기 글|함께 보면 좋은 글|related posts|you may also like|most read this week)$",
    r"^(?:작성자|게시자) ?: |^글쓴이 |^담당부서 |^(?:등록일|작성일|최종수정|date) ?:? ?\d|^조회수? ?:? ?\d|^contact unit|^department ?: |^posted by|^written by|^views? ?:? ?\d",
    r"^(?:이전글|다음글|prev|next|▲|▼) ?:? ?.*(?:제\d+-\d+호|no\. \d+-\d+)",
    r"^\d+ / \d+ ?쪽?$|^(?:처음 )?[«<]? ?\d+(?: \d+)+ ?[»>]?(?: 다음| 끝| next)?$",
    r"^#\S+(?: #\S+)*$",
    "^(?:home|홈|현재 위치)[: ]+.*[>›]",
    "^language ?:|is not responsible for the content of linked|unauthorised collection|nurisol university, |^privacy notice of|portal home$|skip navigation|skip to main|share this .* page",
    "copy the address|storage settings|stores small files|all texts on the .* may be quoted|follow .* updates every|we measure visits",
    "some menus need|enter your student number|type a keyword|menu works best",
    "아이디 입력 비밀번호|검색어를 입력|찾을 낱말|스크립트가 꺼져 있으면|스크립트 미지원 화면|자바스크립트를 켜면 더|^noscript: |전자우편 주소를 입력해 주세요",
)]
_OTHER_POST = re.compile(r"\((?:제\d+-\d+호|no\. \d+-\d+)\)?$")


def labelled(text: str, title: str) -> list[tuple[str, bool, str, int]]:
    """Line, is title, region, label (1 main body)."""
    lines, titles, regions = PageModel.layout(None, text, title)
    out = []
    for line, is_title, region in zip(lines, titles, regions):
        if not line.strip():
            continue
        raw = re.sub(r"\s+", " ", visual_key(line)).strip().lower()
        n = _EDGE.sub("", raw).rstrip(".")
        around = not is_title and (any(p.search(n) or p.search(raw) for p in RULES) or bool(_OTHER_POST.search(n) or _OTHER_POST.search(raw)))
        out.append((line, is_title, region, 0 if around else 1))
    return out


def train(pages: list[tuple[str, str]], epochs: int = 6, rate: float = 0.25, min_count: int = 4, keep: int = 4_000) -> dict:
    data = [labelled(t, title) for t, title in pages]
    ends = Counter(tail(re.sub(r"\s+", " ", visual_key(title)).strip().lower()) for _, title in pages if title)
    tails = frozenset(t for t, n in ends.items() if t and n >= TAIL_SHARE * len(pages))
    counts: Counter = Counter()
    rows = []
    for page in data:
        for line, is_title, region, y in page:
            f, kind = features(line, is_title, region, tails)
            f = [x for x in f if not any(name in x for name in SITE_NAMES)]
            counts.update(f)
            rows.append((f, kind, region, y))
    index = {f: i for i, (f, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))) if n >= min_count}
    idx = [np.array([index[x] for x in f if x in index]) for f, *_ in rows]
    ys = np.array([r[3] for r in rows], dtype=float)
    w, g2 = np.zeros(len(index)), np.full(len(index), 1e-6)
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = idx[i]
            # Half of the word features are hidden at a time, so no line rests on one feature alone.
            x = x[rng.random(len(x)) < 0.6]
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(), -30, 30)))
            g = (p - ys[i]) + 1e-4 * w[x]
            g2[x] += g * g
            w[x] -= rate * g / np.sqrt(g2[x])
    names = list(index)
    order = sorted(range(len(names)), key=lambda i: -abs(w[i]) * min(counts[names[i]], 50) ** 0.5)[:keep]
    weights = {names[i]: round(float(w[i]), 2) for i in sorted(order, key=lambda i: names[i]) if abs(w[i]) >= 0.05}
    region, block, line = Counter(), Counter(), Counter()
    for page in data:
        for r in ("head", "tail", "whole", "tail0", "whole0"):
            own = [(ln, t, y) for ln, t, rg, y in page if rg == r]
            if not own:
                continue
            r_label = int(sum(y for *_, y in own) * 2 > len(own))
            region[r, r_label] += 1
            blocks: list[tuple[str, list[int]]] = []
            for ln, t, y in own:
                kind = features(ln, t, r, tails)[1]
                if blocks and blocks[-1][0] == kind:
                    blocks[-1][1].append(y)
                else:
                    blocks.append((kind, [y]))
            for kind, labels in blocks:
                b = int(sum(labels) * 2 > len(labels))
                block[kind, r_label, b] += 1
                for y in labels:
                    line[b, y] += 1
    share = lambda a, b: round((b + 1) / (a + b + 2), 4)
    kinds = sorted({k for k, *_ in block})
    return {
        "region": {r: share(region[r, 0], region[r, 1]) for r in ("head", "tail", "whole", "tail0", "whole0")},
        "block": {k: [share(block[k, r, 0], block[k, r, 1]) for r in (0, 1)] for k in kinds},
        "line": [share(line[b, 0], line[b, 1]) for b in (0, 1)],
        "tails": sorted(tails),
        "weights": weights,
    }


def errors(model: dict, pages: list[tuple[str, str]]) -> str:
    """Agreement with the annotation rules on labelled pages."""
    m, hit, found, true, n = PageModel(model), 0, 0, 0, 0
    for text, title in pages:
        p = [q for q, x in zip(m.marginals(text, title), text.split("\n")) if x.strip()]
        for q, (*_, y) in zip(p, labelled(text, title)):
            n += 1
            true += not y
            found += q < 0.5
            hit += q < 0.5 and not y
    return f"{len(pages)} pages, {n} lines, recall {hit / max(true, 1):.5f}, precision {hit / max(found, 1):.5f}"


def main(paths: list[str]) -> None:
    import pandas as pd

    hold = int(paths[1]) if paths[0] == "--held-out" else 0
    paths = paths[2:] if hold else paths
    pages, left_out = [], []
    for p in paths:
        d = pd.read_parquet(p, columns=["doc_id", "raw_text", "title", "source_type"]).sort_values("doc_id")
        d = d[d.raw_text.notna()].head(MAX_PAGES // len(paths))
        out = set(sorted(d.source_type.unique())[::hold]) if hold else set()
        for text, title, kind in zip(d.raw_text, d.title, d.source_type):
            (left_out if kind in out else pages).append((text, title))
    model = train(pages)
    if hold:
        print("held-out kinds of site:", errors(model, left_out))
    else:
        MODEL.write_text(json.dumps(model, ensure_ascii=False, indent=0, sort_keys=True), encoding="utf-8")


if __name__ == "__main__":
    main(sys.argv[1:])
