"""Declarative semantic indexing and weighted vector search on Spark DataFrames."""

from tesserine.functions.images import ByteEmbedder, GradientEmbedder, load_images, resize_blobs
from tesserine.functions.learned import LearnedEmbedder
from tesserine.functions.text import CachedEmbedder, HashedEmbedder, chunk_text, chunked
from tesserine.operators.cells import CellIndex
from tesserine.operators.codes import CodeIndex
from tesserine.operators.index import Effect, Index
from tesserine.operators.spaces import CategoricalSimilaritySpace, CustomSpace, ImageSpace, InputAggregation, LinearScale, LogarithmicScale, Mode, NumberSpace, PeriodTime, RecencySpace, TextSimilaritySpace, chunk
from tesserine.plans.app import App, InMemoryExecutor, InMemorySource, QueryResult, Source
from tesserine.plans.natural import ModelFiller, RuleFiller, SlotFiller
from tesserine.plans.query import Param, Query, QueryUserConfig, batch_top_k
from tesserine.schema import Blob, Boolean, CreatedAtField, EventSchema, Float, FloatList, IdField, Integer, Schema, SchemaError, SchemaReference, String, StringList, Timestamp
from tesserine.sources.plugin import Condition, plugged
from tesserine.sources.readers import DataFormat, DataLoaderConfig
from tesserine.sources.stored import BucketedRows, StoredEmbeddings, persist_clustered

__all__ = [n for n in dir() if n[0].isupper()] + ["batch_top_k", "chunk", "chunk_text", "chunked", "load_images", "persist_clustered", "plugged", "resize_blobs"]
