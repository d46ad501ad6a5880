"""Reason codes and message formats written into result columns."""

ITEMS_PATH_NOT_FOUND = "ITEMS_PATH_NOT_FOUND"
DEDUPE_KEY_MISSING = "DEDUPE_KEY_MISSING"
TRANSFORM_FAILED = "TRANSFORM_FAILED"
EVENT_NOT_FOUND = "EVENT_NOT_FOUND"
INVALID_JSON = "INVALID_JSON"
INVALID_BODY = "invalid_body"
LEASE_EXPIRED = "LEASE_EXPIRED"
UNKNOWN_FLOW = "PIPELINE_DESCONHECIDO"

BODY_NOT_ITEMS = "corpo nao e objeto nem lista de objetos"
ITEMS_PATH_ABSENT = "itemsPath '{path}' ausente no corpo"
ITEMS_PATH_NOT_ITEMS = "itemsPath '{path}' nao aponta para objeto ou lista"
KEY_MISSING = "nenhuma chave de deduplicacao resolvida (esperado {expected})"
KEY_PART_JOIN = "+"
KEY_ALTERNATIVE_JOIN = " ou "
FIELD_PREFIX = "campo '{path}': "
NOT_SCALAR = "valor nao escalar para cast {cast}"
NOT_NUMBER = "nao e numero"
NOT_INTEGER = "nao e inteiro"
NOT_BOOLEAN = "nao e booleano"
NOT_DATE = "nao e data"
OBJECT_TEXT = "[object Object]"
EVENT_PURGED = "evento nao encontrado (purgado antes da entrega?)"
LEASE_LOST = "worker morreu ou travou durante a entrega"
NETWORK_FAILURE = "falha de rede ao coletar pagina {page}"
PAGE_STATUS = "pagina {page} respondeu HTTP {status}"
PAGE_NOT_JSON = "pagina {page} nao devolveu JSON"
OUTSIDE_SUCCESS_LIST = "_FORA_DE_SUCCESS_STATUSES"
REDIRECT = "_REDIRECT"
TRUNCATED = "...[truncado]"
TOO_DEEP = "[profundidade excedida]"

TRUE_WORDS = ("true", "1", "sim", "s", "yes")
FALSE_WORDS = ("false", "0", "nao", "n", "no")

MAX_KEY_SOURCE = 500
MAX_REQUEST_BODY = 8 * 1024
MAX_RESPONSE_BODY = 4 * 1024
MAX_MESSAGE = 2_000
MAX_MASK_DEPTH = 8
