"""The sample table of customers."""

from keepwell.plans import views as v
from keepwell.plans.views import oracle

QUERIES = {
    "view_customers": (lambda s, d: v.customers(s, d), oracle("customers", "SELECT * FROM customers")),
}
