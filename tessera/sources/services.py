"""Search pages and details of the XML services of decisions, read by each service's table of fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip_html
from tessera.sources.envelopes import once, xml_detail, xml_page


@dataclass(frozen=True)
class Service:
    """Fields (name to element) of a service's items and of its details.

    cleaned: details whose markup goes; bare: details that lose dots and dashes; needed: items without this field go;
    refused: the root that says that there is no such document.
    """

    tag: str
    listed: dict[str, str]
    detail: dict[str, str]
    cleaned: tuple[str, ...] = ()
    bare: tuple[str, ...] = ()
    needed: str | None = None
    refused: str | None = None


# The services' elements and what their fields are called.
SERVICES = {
    "precedents": Service(
        "prec",
        {
            "prec_id": "판례일련번호", "case_name": "사건명", "case_number": "사건번호", "decision_date": "선고일자", "court_name": "법원명", "court_type": "법원종류코드",
            "case_type": "사건종류명", "case_type_code": "사건종류코드", "decision_type": "판결유형", "선고": "선고", "source": "데이터출처명", "detail_url": "판례상세링크",
        },
        {
            "court_name": "법원명", "court_type": "법원종류코드", "case_type": "사건종류명", "case_type_code": "사건종류코드", "decision_type": "판결유형",
            "decision_date": "선고일자", "판시사항": "판시사항", "판결요지": "판결요지", "이유": "참조조문",
        },
        cleaned=("판시사항", "판결요지", "이유"),
    ),
    "supreme": Service(
        "prec",
        {"prec_id": "판례일련번호", "case_number": "사건번호", "case_name": "사건명", "decision_date": "선고일자", "court_name": "법원명", "case_type_code": "사건종류코드", "case_type_name": "사건종류명"},
        {
            "prec_id": "판례정보일련번호", "case_number": "사건번호", "case_name": "사건명", "decision_date": "선고일자", "court_name": "법원명", "case_type_code": "사건종류코드",
            "case_type_name": "사건종류명", "판시사항": "판시사항", "판결요지": "판결요지", "참조조문": "참조조문", "참조판례": "참조판례", "판례내용": "판례내용",
        },
        needed="prec_id", refused="Law",
    ),
    "constitutional": Service(
        "Detc",
        {"decision_id": "헌재결정례일련번호", "case_number": "사건번호", "case_name": "사건명", "decision_date": "종국일자"},
        {
            "decision_id": "헌재결정례일련번호", "case_number": "사건번호", "case_name": "사건명", "decision_date": "종국일자", "case_type_code": "사건종류코드", "case_type_name": "사건종류명",
            "판시사항": "판시사항", "결정요지": "결정요지", "전문": "전문", "참조조문": "참조조문", "참조판례": "참조판례", "심판대상조문": "심판대상조문",
        },
        refused="Law",
    ),
    "interpretations": Service(
        "expc",
        {
            "expc_id": "법령해석례일련번호", "case_title": "안건명", "case_number": "안건번호", "decision_date": "회신일자", "issuer": "회신기관명", "issuer_code": "회신기관코드",
            "requester": "질의기관명", "requester_code": "질의기관코드", "detail_url": "법령해석례상세링크",
        },
        {
            "decision_date": "해석일자", "issuer": "해석기관명", "issuer_code": "해석기관코드", "requester": "질의기관명", "requester_code": "질의기관코드",
            "질의요지": "질의요지", "회답": "회답", "이유": "이유",
        },
        cleaned=("질의요지", "회답", "이유"), bare=("decision_date",),
    ),
}


def page(payload: Column, service: Service) -> Column:
    """struct(total, items) of a search reply; 0 and no items where it isn't XML. Items without the field that is needed go."""
    found = xml_page(payload, service.tag, service.listed)
    if service.needed is None:
        return found
    return once(found, lambda p: F.struct(p["total"].alias("total"), F.filter(p["items"], lambda x: x[service.needed] != "").alias("items")))


def detail(payload: Column, service: Service, asked: Column | None = None) -> Column:
    """struct of a detail reply's fields; null where the service refuses or nothing parses. An empty id of those needed becomes the one asked for."""
    def finished(found: Column) -> Column:
        own = {n: found[n] for n in service.detail}
        for n in service.cleaned:
            own[n] = strip_html(own[n])
        for n in service.bare:
            own[n] = F.translate(own[n], ".-", "")
        if asked is not None and service.needed is not None:
            own[service.needed] = F.coalesce(F.nullif(own[service.needed], F.lit("")), asked)
        return F.when(found.isNotNull(), F.struct(*[c.alias(n) for n, c in own.items()]))

    return once(xml_detail(payload, service.detail, service.refused), finished)
