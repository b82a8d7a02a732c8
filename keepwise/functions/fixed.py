"""Fixed values that must equal the reference's for the same results.

Everything in this module is a constant table or cut-off, stated as plain text in
the reference's own order. Operators read these; nothing else is hard-coded.
"""

from __future__ import annotations

import math

# ---------------------------------------------------------------------------
# Risk bands, thresholds, report grids, labels.
# ---------------------------------------------------------------------------
RISK_LOW_MAX = 0.3       # p < 0.3 -> Low
RISK_MEDIUM_MAX = 0.6    # p <= 0.6 -> Medium, else High
RISK_LABELS = ("Low", "Medium", "High")
RISK_LABELS_DASHBOARD = ("Baixo", "Médio", "Alto")   # same cuts, dashboard wording
HIGH_RISK_MIN = 0.3      # p >= 0.3 shows the driver list

DEFAULT_THRESHOLD = 0.5
SWEEP_START, SWEEP_STOP, SWEEP_STEP = 0.20, 0.81, 0.05
MIN_RECALL = 0.60
TOP_PCTS = [5, 10, 15, 20, 25, 30, 40, 50]
N_DECILES = 10

CHURN_LABELS = {0: "Sem churn", 1: "Churn"}

HIGH_RISK_POOL_PCT = 20
MONTHS_HORIZON = 12
DEFAULT_CAMPAIGN = {"pct_contacted": 50.0, "success_rate": 25.0,
                    "cost_per_contact": 15.0, "avg_discount": 10.0}
CAPACITY_DEFAULT_MAX = 100   # default N = min(100, max(1, n // 5))

SPLIT_RATIOS = (0.7, 0.15, 0.15)
SPLIT_SEED = 42
N_REPEATS = 5
TOP_K = 10

# ---------------------------------------------------------------------------
# Plain-language hints, first contained key wins, in this order.
# ---------------------------------------------------------------------------
HINTS = [
    ("contract", "Contract type (e.g. month-to-month vs annual). Short or month-to-month contracts are often tied to higher churn."),
    ("tenure", "How long the customer has been with the company. Shorter tenure often means higher churn risk."),
    ("monthlycharges", "Monthly bill amount. Very high charges can push some customers to leave."),
    ("totalcharges", "Total amount paid so far. Reflects both tenure and spend; low totals can mean new or low-engagement customers."),
    ("electroniccheck", "Paying by electronic check (vs automatic or mailed). Often linked to higher churn, e.g. more manual steps or different segment."),
    ("mailedcheck", "Paying by mailed check. Manual payment methods are often associated with higher churn than automatic."),
    ("banktransfer", "Bank transfer (automatic) payment. Automatic payments tend to go with lower churn."),
    ("creditcard", "Credit card (automatic) payment. Same as above; less friction and more commitment."),
    ("paymentmethod", "How the customer pays. Automatic payments are typically associated with lower churn."),
    ("internetservice", "Type of internet (e.g. fiber, DSL, none). Fiber and quality of service affect satisfaction and churn."),
    ("fiber", "Fiber internet. Service quality and expectations; can drive both satisfaction and churn depending on experience."),
    ("dsl", "DSL internet. Often a different segment from fiber; engagement and expectations differ."),
    ("onlinesecurity", "Whether they have online security add-ons. Having add-ons often means higher engagement and lower churn."),
    ("techsupport", "Tech support add-on. Can reduce churn by helping resolve issues."),
    ("streaming", "Streaming TV or movies. Usage of add-ons is a signal of engagement."),
    ("paperless", "Paperless billing. Preference and habit; often correlates with other behaviors."),
    ("partner", "Having a partner (e.g. household). Can reflect segment and stability."),
    ("dependents", "Having dependents. Often tied to household type and commitment."),
    ("gender", "Gender. Demographic signal; importance depends on segment mix."),
    ("senior", "Senior citizen flag. Age segment can have different churn patterns."),
    ("phoneservice", "Having phone service. Part of the product bundle and engagement."),
    ("multiplelines", "Multiple phone lines. Another signal of bundle size and engagement."),
    ("deviceprotection", "Device protection add-on. Add-ons tend to correlate with lower churn."),
    ("onlinebackup", "Online backup add-on. Same as above."),
    ("nointernetservice", "No internet service. Reflects product mix; different risk profile."),
    ("nophoneservice", "No phone service. Same idea; bundle and engagement signal."),
]
DEFAULT_HINT = "Influences churn risk; see data and domain experts for context."

# ---------------------------------------------------------------------------
# Sentences of the threshold recommendation. Placeholders: {recall_min}
# in whole percent, {threshold} with two decimals, {f1}, {recall}, {precision} with four.
# ---------------------------------------------------------------------------
RECOMMEND_BEST = ("For churn prevention, missing churners (FN) is usually costlier than wasted retention (FP). "
                  "Among thresholds with recall >= {recall_min}, {threshold} gives the best F1 ({f1}) while keeping "
                  "recall {recall} and precision {precision}. Recommended threshold: {threshold}.")
RECOMMEND_NONE = ("No threshold reached recall >= {recall_min}. Using {threshold} (recall {recall}, precision {precision}) "
                  "to prioritize catching churners. Consider lowering the threshold if retention capacity allows more outreach.")
RECOMMEND_EMPTY = "Insufficient data for recommendation."
RECOMMEND_HEADER = "Recommended threshold (churn prevention): {threshold}"

# ---------------------------------------------------------------------------
# Retention playbook (segment, risk signal, suggested action).
# ---------------------------------------------------------------------------
PLAYBOOK = [
    ("Contrato", "Contrato mês a mês",
     "Ofertar contrato anual ou bienal; desconto por compromisso."),
    ("Pagamento", "Pagamento manual (cheque, boleto etc.)",
     "Incentivar débito automático ou pagamento por cartão."),
    ("Cobrança", "Cobrança mensal alta",
     "Revisar plano e ofertas; considerar descontos para adequar ao valor percebido."),
    ("Internet", "Internet fibra",
     "Acompanhar reclamações e qualidade; ofertar suporte ou ajuste de plano."),
    ("Relacionamento", "Pouco tempo de relação com a empresa",
     "Priorizar onboarding e ofertas de fidelização nos primeiros meses."),
]

# ---------------------------------------------------------------------------
# Per-customer risk drivers, checked in this order.
# Placeholders: {tenure} is the tenure in months, {charge} the monthly charge
# with one decimal.
# ---------------------------------------------------------------------------
DRIVER_MONTH_TO_MONTH = "Month-to-month"
DRIVER_SHORT_TENURE_MONTHS = 12
DRIVER_MANUAL_PAYMENTS = ("Electronic check", "Mailed check")
DRIVER_HIGH_CHARGE_FACTOR = 1.2
DRIVER_FIBER_TOKEN = "Fiber"
DRIVER_FIBER_NAME = "fiber optic"
DRIVER_TEXTS = [
    ("Contrato mês a mês",
     "Quem está sem compromisso de prazo pode sair a qualquer momento, sem custo de saída.",
     "Oferecer plano anual ou bienal com benefício (desconto, upgrade) em troca de fidelidade."),
    ("Pouco tempo de relação ({tenure} meses)",
     "Cliente ainda não criou hábito nem vínculo; troca de operadora pode parecer simples.",
     "Reforçar valor do plano (uso, benefícios), contato proativo e oferta de suporte nos primeiros meses."),
    ("Pagamento manual (cheque)",
     "Cada mês exige ação do cliente; atrasos e esquecimentos aumentam insatisfação e risco de saída.",
     "Incentivar débito automático ou cartão, com pequeno benefício ou simplificação."),
    ("Cobrança mensal alta (US$ {charge})",
     "Valor alto sem benefício claro pode gerar sensação de custo excessivo e vontade de cortar.",
     "Mostrar o que está incluso no plano, ajustar oferta ao uso ou oferecer downgrade guiado em vez de cancelamento."),
    ("Internet fibra",
     "Expectativa de qualidade e velocidade é alta; qualquer falha ou custo percebido pesa mais.",
     "Garantir suporte ágil, revisar queixas e oferta de valor (velocidade, pacotes) antes que procure concorrente."),
]
# End of fixed values.

# Which playbook segment each driver rule belongs to (our mapping, in rule order).
DRIVER_SEGMENTS = ["Contrato", "Relacionamento", "Pagamento", "Cobrança", "Internet"]


def sweep_thresholds() -> list[float]:
    """The 13 sweep thresholds, bit-equal to a float ``arange(0.20, 0.81, 0.05)``.

    A float range adds ``i * delta`` to the start, where ``delta`` is the step as
    seen from the start, so 0.4 comes out as 0.39999999999999997.
    """
    delta = (SWEEP_START + SWEEP_STEP) - SWEEP_START
    n = math.ceil((SWEEP_STOP - SWEEP_START) / SWEEP_STEP)
    return [SWEEP_START + i * delta for i in range(n)]
