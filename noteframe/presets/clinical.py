"""Fixed values of the clinical preset: markers, cues, rule thresholds, labels, templates.

Everything here is data for the generic operators; results depend on these exact texts.
"""

from __future__ import annotations

from ..operators.markers import Cue, MarkerSpec, Ontology
from ..operators.rules import RuleMatrix, active, all_of, at_least, graded_at_least

# The marker ontology (names, mention patterns, denial patterns).
MARKERS = (
    MarkerSpec(
        "ideacao_suicida",
        ("pensamentos de morte", "ideação suicida", "ideacao suicida"),
        ("nega ideação suicida", "nega ideacao suicida", "sem ideação", "sem ideacao"),
    ),
    MarkerSpec(
        "planejamento_suicida",
        ("planejamento de autoagressão", "planejamento de autoagressao", "planejamento suicida"),
        ("sem planejamento", "nega planejamento"),
    ),
    MarkerSpec(
        "autoagressao_iminente",
        (
            "risco iminente de autoagressão",
            "risco iminente de autoagressao",
            "autoagressão iminente",
            "autoagressao iminente",
        ),
        ("nega (?:risco iminente de )?autoagress", "sem risco iminente"),
    ),
    MarkerSpec(
        "risco_violencia",
        ("risco de comportamento agressivo", "risco de violência", "risco de violencia"),
        ("nega risco de violência", "nega risco de violencia"),
    ),
    MarkerSpec(
        "sintomas_psicoticos",
        (
            "percepção alterada da realidade",
            "percepcao alterada da realidade",
            "ideias de referência",
            "ideias de referencia",
            "sintomas psicóticos",
            "sintomas psicoticos",
        ),
        ("nega sintomas psicóticos", "nega sintomas psicoticos"),
    ),
    MarkerSpec(
        "uso_problematico_substancias",
        (
            "uso de álcool ou outras substâncias com prejuízo",
            "uso de alcool ou outras substancias com prejuizo",
            "uso problemático de substâncias",
            "uso problematico de substancias",
        ),
        ("nega uso problemático", "nega uso problematico"),
    ),
    MarkerSpec(
        "internacao_previa",
        ("internação prévia", "internacao previa"),
        ("nega internação prévia", "nega internacao previa"),
    ),
    MarkerSpec(
        "agravamento_recente",
        (
            "piora recente",
            "agravamento recente",
            "piora dos sintomas nas últimas semanas",
            "piora dos sintomas nas ultimas semanas",
        ),
        ("sem (?:piora|agravamento) recente", "nega (?:piora|agravamento) recente"),
    ),
    MarkerSpec(
        "suporte_social_baixo",
        ("rede de apoio limitada", "suporte social limitado"),
        ("rede de apoio disponível", "rede de apoio disponivel"),
    ),
    MarkerSpec(
        "comprometimento_funcional",
        (
            "dificuldade leve para manter",
            "dificuldade moderada para manter",
            "importante comprometimento para atividades",
        ),
        ("funcionalidade preservada",),
        severity=(
            Cue("importante comprometimento", "importante", 3),
            Cue("dificuldade moderada", "moderado", 2),
            Cue("dificuldade leve", "leve", 1),
        ),
        graded=True,
    ),
)

# Cue lists and closed value lists.
ONTOLOGY = Ontology(
    version="ontology_v2",
    markers=MARKERS,
    remote_cues=("há dois anos", "ha dois anos", "prévia", "previa", "remoto", "passado", "anterior"),
    current_cues=(
        "atual",
        "atualmente",
        "no momento",
        "nesta semana",
        "recent[e]?",
        "últimas semanas",
        "ultimas semanas",
    ),
    severity_cues=(
        Cue("iminente|intenso|importante|grave", "alto", 3),
        Cue("moderad", "moderado", 2),
        Cue("leve", "leve", 1),
    ),
    uncertain_cues=("possivelmente", "pode", "suspeita", "incerto"),
    third_party_cues=("mãe", "mae", "pai", "um familiar", "familiar apresenta", "família apresenta"),
    current="atual",
    remote="remoto",
    unspecified="nao_especificado",
    absent="ausente",
    default_severity=Cue("", "leve", 1),
    scalar_severity=("ausente", "leve", "moderado", "importante"),
    severities=("ausente", "leve", "moderado", "alto", "importante", "nao_especificado"),
    affirmed="afirmado",
    uncertain="incerto",
    self_experiencer="paciente",
    other_experiencer="terceiro",
)

# Column names and prefixes.
KEY = "patient_id"
SOURCE_PREFIX = "marcadores_origem_"
EXTRACTED_PREFIX = "marcadores_extraidos_"
CANONICAL_PREFIX = "marker_"
SCORES = ("phq9_total", "gad7_total", "idate_estado_total")
TARGETS = ("prioridade_referencia", "prioridade_referencia_codigo", "urgent_rule_triggered")
DROPPED_PROFILE_COLUMNS = ("seed", "gravidade_latente_auditoria")
EXTRACTOR_ID = "rule-dictionary-qualified-v2"
REFERENCE_NAMES = {
    "priority_label": "prioridade_referencia",
    "priority_code": "prioridade_referencia_codigo",
}
CRITICAL_MARKERS = (
    "ideacao_suicida",
    "planejamento_suicida",
    "autoagressao_iminente",
    "risco_violencia",
    "sintomas_psicoticos",
)
SEVERITY_BY_CODE = ("ausente", "leve", "moderado", "alto")
GRADED_TOP_SEVERITY = "importante"

# Ordinal labels, rule thresholds and weights.
LABELS = ("baixa", "moderada", "alta", "urgente")
THRESHOLDS = {
    "phq_moderate": 10,
    "phq_high": 20,
    "gad_moderate": 10,
    "gad_high": 15,
    "stai_moderate": 50,
    "stai_high": 65,
    "vulnerability_high": 0.66,
    "high_evidence_weight": 0.85,
    "moderate_evidence_weight": 0.35,
    "high_priority_cutoff": 3.0,
    "moderate_priority_cutoff": 1.2,
}
FUNCTIONAL = "comprometimento_funcional"
RULES = RuleMatrix(
    version="priority-matrix-v2-draft",
    inputs=(*SCORES, "social_vulnerability"),
    urgent=(
        all_of(active("ideacao_suicida"), active("planejamento_suicida")),
        active("autoagressao_iminente"),
        active("risco_violencia"),
        all_of(active("sintomas_psicoticos"), graded_at_least(FUNCTIONAL, 3)),
    ),
    high=(
        at_least("phq9_total", "phq_high"),
        at_least("gad7_total", "gad_high"),
        at_least("idate_estado_total", "stai_high"),
        graded_at_least(FUNCTIONAL, 2),
        active("uso_problematico_substancias"),
        active("agravamento_recente"),
        at_least("social_vulnerability", "vulnerability_high"),
        active("suporte_social_baixo"),
    ),
    moderate=(
        at_least("phq9_total", "phq_moderate"),
        at_least("gad7_total", "gad_moderate"),
        at_least("idate_estado_total", "stai_moderate"),
        graded_at_least(FUNCTIONAL, 1),
        active("agravamento_recente"),
        active("suporte_social_baixo"),
    ),
    thresholds=THRESHOLDS,
    labels=LABELS,
)

# Questionnaire bands, reverse items and scenario list.
PHQ_BANDS = ((-1, 4, 9, 14, 19, 27), ("minimo", "leve", "moderado", "moderadamente_grave", "grave"))
GAD_BANDS = ((-1, 4, 9, 14, 21), ("minimo", "leve", "moderado", "grave"))
REVERSED_ITEMS = (1, 2, 5, 8, 10, 11, 15, 16, 19, 20)
VULNERABILITY_WEIGHTS = {
    "renda_baixa": 0.30,
    "escolaridade_baixa": 0.20,
    "inseguranca_alimentar": 0.25,
    "moradia_precaria": 0.25,
}

# Texts of the ranked table.
CLASS_TITLES = {"baixa": "Baixa", "moderada": "Moderada", "alta": "Alta", "urgente": "Urgente"}
GENDER_TITLES = {
    "feminino": "Feminino",
    "masculino": "Masculino",
    "outro_ou_nao_informado": "Outro ou não informado",
}
FUNCTIONAL_TITLES = ("Ausente", "Leve", "Moderado", "Importante")
SIGNAL_TITLES = {
    "ideacao_suicida": "Ideação suicida atual",
    "planejamento_suicida": "Planejamento de autoagressão",
    "autoagressao_iminente": "Autoagressão iminente",
    "risco_violencia": "Risco de violência",
    "sintomas_psicoticos": "Sintomas psicóticos",
    "uso_problematico_substancias": "Uso problemático de substâncias",
    "internacao_previa": "Internação prévia",
    "agravamento_recente": "Agravamento recente",
    "suporte_social_baixo": "Suporte social baixo",
}
NO_SIGNAL = "Nenhum marcador extraído"
NOT_AVAILABLE = "Não disponível"
STATUS_TITLES = ("Presente", "Negado", "Antecedente remoto", "Não mencionado")
YES, NO = "Sim", "Não"

# Titles of features and markers in explanations.
MARKER_TITLES = {
    "ideacao_suicida": "Ideação suicida",
    "planejamento_suicida": "Planejamento suicida",
    "autoagressao_iminente": "Autoagressão iminente",
    "risco_violencia": "Risco de violência",
    "sintomas_psicoticos": "Sintomas psicóticos",
    "uso_problematico_substancias": "Uso problemático de substâncias",
    "internacao_previa": "Internação prévia",
    "agravamento_recente": "Agravamento recente",
    "suporte_social_baixo": "Suporte social baixo",
    "comprometimento_funcional": "Comprometimento funcional",
}
FEATURE_TITLES = {
    "phq9_total": "PHQ-9 total",
    "gad7_total": "GAD-7 total",
    "idate_estado_total": "IDATE-Estado total",
    "social_vulnerability": "Vulnerabilidade social",
    "income_normalized": "Renda normalizada",
    "age_years": "Idade",
}
FEATURE_PREFIXES = ("numeric__", "categorical__")
QUALIFIER_TITLES = {
    "present": "presença",
    "negated": "negação",
    "remote_present": "antecedente remoto",
    "severity_code": "código de severidade",
}
TITLE_JOINER = " — "

# Phrases of a rendered note.
SCORE_PHRASES = (
    "refere sofrimento emocional intenso, com sintomas persistentes de humor deprimido e ansiedade",
    "refere sintomas de ansiedade e humor deprimido com repercussão no cotidiano",
    "refere sintomas leves e oscilantes de ansiedade ou humor",
    "refere sintomas emocionais leves e atualmente estáveis",
)
SCORE_STEPS = ((20, 15, 65), (10, 10, 50), (5, 5, None))
FUNCTIONAL_PHRASES = (
    "mantém funcionalidade preservada nas atividades habituais",
    "relata dificuldade leve para manter as atividades habituais",
    "relata dificuldade moderada para manter atividades cotidianas",
    "relata importante comprometimento para atividades cotidianas",
)
FUNCTIONAL_UNKNOWN = "não foi possível caracterizar a funcionalidade"
SUPPORT_PHRASES = (
    "Paciente refere rede de apoio limitada no momento.",
    "Paciente refere rede de apoio disponível no momento.",
)
TERMS = {
    "ideacao_suicida": "ideação suicida",
    "planejamento_suicida": "planejamento suicida",
    "autoagressao_iminente": "autoagressão iminente",
    "risco_violencia": "risco de violência",
    "sintomas_psicoticos": "sintomas psicóticos",
    "uso_problematico_substancias": "uso problemático de substâncias",
    "internacao_previa": "internação prévia relacionada a sofrimento psíquico",
    "agravamento_recente": "agravamento recente dos sintomas",
}
SUBJECTS = ("Paciente", "Um familiar")
TENSES = {"atual": "atualmente", "remoto": "no passado", "nao_especificado": ""}
HEDGE = "possivelmente "
VERBS = ("apresentou", "nega", "apresenta")
PAST = "no passado"
OPENINGS = ("Usuário", "Pessoa acompanhada", "Paciente fictício")
ASSESSMENT = (
    "Avaliação: Quadro compatível, no cenário sintético, com necessidade de acompanhamento "
    "conforme evolução e rede de suporte."
)
TEMPLATE_ID = "template-simulator-v1"
PROMPT_VERSION = "narrativa_soap_v1"
NOTE_PREFIX = "NAR"
