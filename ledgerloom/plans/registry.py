"""All registered queries."""

from __future__ import annotations

from . import cash_plans, document_plans, edit_plans, lifecycle_plans, model_plans, package_plans, record_plans, reference_plans, scalar_plans, statement_plans, supplier_plans
from .catalog import Catalog

CATALOG = Catalog().merge(cash_plans.CATALOG, reference_plans.CATALOG, supplier_plans.CATALOG, document_plans.CATALOG, edit_plans.CATALOG, scalar_plans.CATALOG, statement_plans.CATALOG, model_plans.CATALOG, lifecycle_plans.CATALOG, package_plans.CATALOG, record_plans.CATALOG)
