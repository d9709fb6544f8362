"""From a named source database to the views that the fact builders read (A1).

Each view is one source table with its columns renamed and typed; renames and
same-type casts leave date and flag predicates of the facts where a JDBC or
Parquet source can take them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.sources.registry import SourceSpec

# Source tables and columns (name, type) behind each view's columns.
VIEWS: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "quote_src": ("Quote", {
        "id": ("Id", "bigint"), "client_id": ("ClientId", "bigint"),
        "created_date": ("CreatedDate", "timestamp_ntz"), "quote_date": ("QuoteDate", "timestamp_ntz"),
        "expire_date": ("ExpireDate", "timestamp_ntz"), "product_id": ("ProductId", "int"),
        "quote_save_from": ("QuoteSaveFrom", "int"), "quote_number": ("QuoteNumber", "string"),
        "pet_name": ("PetName", "string"), "breed_id1": ("PetBreedId", "int"),
        "breed_id2": ("PetSeconderyBreedId", "int"), "breed_id3": ("PetBreedId3", "int"),
        "hear_about_us": ("HearAboutUs", "bigint"), "first_name": ("FirstName", "string"),
        "last_name": ("LastName", "string"), "email": ("Email", "string"), "mobile": ("Mobile", "string"),
        "created_by": ("CreatedBy", "int"), "quote_parent_id": ("QuoteParentId", "bigint"),
        "executive_id": ("ExecutiveId", "bigint"), "migrated_quote_id": ("MigratedQuoteId", "bigint"),
        "is_pet_id_product": ("IsPetIdProduct", "int"), "sub_agent_id": ("SubAgentId", "bigint"),
        "pet_birth_date": ("PetBirthDate", "timestamp_ntz"), "title": ("Title", "string"),
        "address1": ("Address1", "string"), "address2": ("Address2", "string"), "suburb": ("Suburb", "string"),
        "post_code": ("PostCode", "string"), "primary_contact_number": ("PrimaryContactNumber", "string")}),
    "client_src": ("Client", {
        "id": ("Id", "bigint"), "first_name": ("FirstName", "string"), "last_name": ("LastName", "string"),
        "email": ("Email", "string"), "address1": ("Address1", "string"), "address2": ("Address2", "string"),
        "suburb": ("Suburb", "string"), "post_code": ("Postcode", "string"),
        "primary_contact_number": ("PrimaryContactNumber", "string"),
        "alternative_contact_number": ("AlternativeContactNumber", "string"),
        "send_document_on_email": ("SendDocumentOnEmail", "boolean")}),
    # An activity stands for its policy: its id is the policy's.
    "policy_src": ("PolicyActivity", {
        "id": ("PolicyId", "bigint"), "quote_id": ("QuoteId", "bigint"),
        "transaction_type_id": ("TransactionTypeId", "int"), "policy_number": ("PolicyNumber", "string"),
        "created_date": ("CreatedDate", "timestamp_ntz"), "product_id": ("ProductId", "int"),
        "pet_name": ("PetName", "string")}),
    "policy_full_src": ("Policy", {
        "id": ("Id", "bigint"), "policy_number": ("PolicyNumber", "string"),
        "created_date": ("CreatedDate", "timestamp_ntz"), "client_id": ("ClientId", "bigint"),
        "executive_id": ("ExecutiveId", "bigint"), "is_free_product": ("IsFreeProduct", "boolean"),
        "is_migrated": ("IsMigrated", "boolean"), "is_pet_id_product": ("IsPetIdProduct", "int"),
        "pet_name": ("PetName", "string"), "insured_name": ("InsuredName", "string"),
        "actual_start_date": ("ActualStartDate", "timestamp_ntz"),
        "actual_end_date": ("ActualEndDate", "timestamp_ntz"), "policy_status_id": ("PolicyStatusId", "int")}),
    "cancel_src": ("PolicyCancellation", {
        "id": ("Id", "bigint"), "policy_id": ("PolicyId", "bigint"), "created_date": ("CreatedDate", "timestamp_ntz")}),
    "answer_src": ("QuoteQuestionAnswer", {
        "id": ("Id", "bigint"), "quote_id": ("QuoteId", "bigint"), "question_id": ("QuestionId", "int")}),
    "list_src": ("QuoteQuestionAnswerDetail", {
        "answer_id": ("QuoteQuestionAnswerId", "bigint"), "answer": ("QuestionAnswer", "string")}),
    "product_dim": ("Product", {
        "id": ("Id", "int"), "parent_product_id": ("ParentProductId", "int"), "product_name": ("ProductName", "string"),
        "product_code": ("ProductCode", "string"), "pet_type_id": ("PetTypeId", "int"),
        "is_free_product": ("IsFreeProduct", "boolean")}),
    "pet_type_dim": ("VuePetType", {"pet_type_id": ("PetType_ID", "int"), "pet_type_name": ("PetTypeName", "string")}),
    "breed_dim": ("Master.Breed", {"id": ("Id", "int"), "breed_name": ("BreedName", "string")}),
    "question_dim": ("QuestionDetail", {"id": ("Id", "int"), "question_detail_name": ("QuestionDetailName", "string")}),
    "hear_about_dim": ("HearAboutUs", {"id": ("Id", "bigint"), "name": ("Name", "string")}),
    "policy_status_dim": ("Master.PolicyStatus", {
        "id": ("Id", "int"), "policy_status_name": ("PolicyStatusName", "string")}),
    "state_dim": ("Master.State", {"id": ("Id", "bigint"), "state_name": ("StateName", "string")}),
    "sub_agent_dim": ("SubAgent", {
        "id": ("Id", "bigint"), "name": ("Name", "string"), "agent_category_id": ("AgentCategoryId", "int"),
        "email": ("Email", "string"), "state_id": ("StateId", "bigint")}),
    "user_dim": ("User", {"id": ("Id", "bigint"), "first_name": ("FirstName", "string")}),
}


def source_schema(view: str) -> T.StructType:
    """The source table's columns that the view reads."""
    _, columns = VIEWS[view]
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in columns.values()])


class SourceViews(Mapping):
    """The views of one named source, each read when asked for.  Its tables are
    large beside a window: the facts read their keys first and cut the other
    tables by them (``reduces``)."""

    reduces = True

    def __init__(self, spark: SparkSession, spec: SourceSpec):
        self.spark, self.spec = spark, spec

    def window(self, view: str, date_col: str, start, end) -> DataFrame:
        """The view's rows of ``[start, end]``, read in parts of that window."""
        table, columns = VIEWS[view]
        rows = self.spec.read_window(self.spark, table, columns[date_col][0], start, end)
        return self._view(rows, columns)

    def __getitem__(self, view: str) -> DataFrame:
        table, columns = VIEWS[view]
        return self._view(self.spec.read(self.spark, table), columns)

    @staticmethod
    def _view(rows: DataFrame, columns) -> DataFrame:
        return rows.select(*[F.col(name).cast(kind).alias(c) for c, (name, kind) in columns.items()])

    def __iter__(self) -> Iterator[str]:
        return iter(VIEWS)

    def __len__(self) -> int:
        return len(VIEWS)
